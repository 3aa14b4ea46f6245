"""Linguistic tables as plain data."""

from __future__ import annotations

SPECIALS = ("[UNK]", "[PAD]", "[BOS]", "[EOS]", "[MASK]")
MARKERS = {name: 100000 + k for k, name in enumerate("num_start num_end space morph_sep pad bos eos mask unk cls sep".split())}

#: Prefix, noun class and confidence; P marks plural, V marks verbs. Longer prefixes come first.
PREFIXES = [
    (p, int(c.rstrip("PV")), "P" in c, "V" in c, float(x))
    for p, c, x in (
        e.split(":")
        for e in (
            "okuw:15V:.9 okuy:15V:.9 okuk:15V:.88 okug:15V:.88 obuw:14:.85 abaw:2P:.88 emiy:4P:.82 ebiy:8P:.82 oku:15V:.92 okw:15V:.91 obu:14:.85 obw:14:.84 otu:13P:.78 olu:11:.85 olw:11:.84 aka:12:.88 "
            "omu:1:.8 omw:1:.8 aba:2P:.92 abw:2P:.9 emi:4P:.83 ama:6P:.88 eki:7:.85 eky:7:.84 ebi:8P:.85 eby:8P:.84 en:9:.65 em:9:.6 am:6P:.7 eb:8P:.65"
        ).split()
    )
]
#: Subject markers by noun class from 1.
SUBJECTS = "a ba gu gi li ga ki bi e zi lu ka tu bu ku".split()

TRUTH = {
    "prefix": "aba aga aka ama awa ba bi bu ebi eki emi en enzi eri ga gu ka ki ku li lu ma mi mu n obu ogu oku olu omu otu tu wa zi".split(),
    "particle": "e na ne ye".split(),
    "root": "gul kola kub lab lim lya nya sinz som tamb tun vub yimb zany zib".split(),
    "suffix": "fu vu ye".split(),
}
CATEGORY_BIT = {"prefix": 1, "particle": 2, "root": 4, "suffix": 8}

#: By language: beginnings of longer words, and words, that count as hits.
LANGUAGE_HITS = {
    "lg": ("aba aka ama eby eki obu oku olu omu otu", "abantu agenda ajja alina anti bakola balina bwe era ggwe kati ku mu naye nga nze omwana tugenda wa wano yakola"),
    "en": ("", "a an are can could do does going has have he her his i is it know market my she the they today was we were will would you your"),
    "sw": ("ki mji vi wa", "habari jina karibu kwa lakini mzuri nakupenda sana wewe"),
}

FORMAL = set(
    "akakasizza amatendekero asabye ategeezezza bakolagana bulange bwayinza byobwannakyeewa diocese ebigambo ebitongole ebiwandiiko empeeerezi enkulaakulana ennukuta ennyingo ensirifu gavumenti kabaka kamalabyonna katikkiro kikuzizza "
    "kitongole kyasaliddwawo lutikko matikkira minisita mmeeya mmengo obwakabaka omubaka omulangira omuterrega owek palamenti pookino ssaabasajja ssekabaka ssemasonga ssentendekero supreme yategeezezza yebazizza".split()
)
COLLOQUIAL = set(
    "2k aliira baby balaaba bambi banange bannayuganda bet betting biffa boobo bro bwenkanya circus clown comedy dala dalala drugs facebook haters hijab jackpot joker jokers kazino kiwaana legend likes love mbu neiba nsiko oga okwesiga "
    "page photo post program selfie smoking store tiktok urgent vest whatsapp".split()
)

MONTHS_TRADITIONAL = "gatonnya mukutulansanja mugulansigo kafuumuulampawu muzigo sseebaaseka kasambula muwakanya mutunda mukulukusa museenene ntenvu".split()
MONTHS_MODERN = "sooka kubiri kusatu kuna kutaano mukaaga musanvu munaana mwenda kkumi kkuminogumu kkuminebiri".split()
MONTHS_ENGLISH = "january february march april may june july august september october november december".split()
DAYS_TRADITIONAL = "kazooba walumbe mukasa kiwanuka nnagawonye wamunyi wangu".split()
DAYS_MODERN = "bbalaza lwakubiri lwakusatu lwakuna lwakutaano lwamukaaga ssande".split()
DAYS_ENGLISH = "monday tuesday wednesday thursday friday saturday sunday".split()


def modern_month(k: int) -> str:
    """Ordinal name of month ``k`` (from 1)."""
    stem = MONTHS_MODERN[k - 1]
    return {1: "ogu", 6: "ogwo", 7: "ogwo", 8: "ogwo", 9: "ogwo", 10: "ogwe", 11: "ogwe", 12: "ogwe"}.get(k, "ogwo") + stem


OPERATORS = {"20": "Uganda Telecom", "31": "Africell", "39": "MTN", "70": "Airtel", "71": "Airtel", "74": "Airtel", "75": "Airtel", "76": "MTN", "77": "MTN", "78": "MTN"}
#: Digits of prefix and number by country code.
DIALLING = {"256": (2, 7), "254": (3, 6), "255": (2, 7)}

#: First word, second word and weight, by category.
PHRASES = [
    (*pair.split("+"), float(w), kind)
    for kind, line in {
        "honorifics": "2:oli+otya,webale+nnyo 1.9:osiibye+otya,wasuze+otya,ssebo+nnyabo 1.8:kulika+yo,weewa+nnyo 1.7:gyendi+ko",
        "connectors": "1.2:ate+nno,era+nnyo,bwe+nga,kuva+mu 1.3:kale+nno,naye+nno,kino+kyo,kino+kiri 1.4:nga+bwe 1.5:olw'+okuba",
        "temporal": "1.6:buli+lunaku,buli+muntu 1.5:buli+saawa 1.4:olunaku+luno,omwezi+guno 1.8:saawa+lumu,saawa+bbiri,saawa+ssatu",
        "auxiliaries": "1.5:asobola+okukola,ayagala+okujja 1.4:agenda+okulya 1.3:ali+mubulamu",
        "idioms": "1.5:nnyo+nnyo 1.6:bambi+bambi",
        "question": "1.5:lwaki+otya 1.4:ani+ayita",
        "negation": "1.4:tewali+kyo 1.2:te+na 1.3:si+mbu",
    }.items()
    for w, pairs in (part.split(":") for part in line.split())
    for pair in pairs.split(",")
]

#: Nasal clusters and the consonants that may underlie them, after the nasal.
NASALS = {"nny": ("n", ["ny", "y"]), "nd": ("n", ["d", "l", "r"]), "mw": ("m", ["w"])} | {
    c: ("n", [c[1]]) for c in ("mb", "mf", "mp", "mv", "nc", "ng", "nj", "nk", "ns", "nt", "nw", "nz")
}
