"""Edit-aware token counts.

A document is a segment tree over blocks of its pre-tokens; every node has the characters and tokens below it. An
edit descends to its place, cuts anew only the blocks that it touches and the pre-tokens beside it that it could
change, and puts the differences into the sums on the way to the root. Pre-tokens are cut from left to right and
what follows a cut depends on nothing before it, so cutting stops at the first old cut behind the edit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _ODD, PATTERN, SIMPLE, Encoder, chunks, encoder

#: Pre-tokens of a block at first, and those from which one is split.
BLOCK, FULL = 64, 512
#: Characters past its end that decide where a pre-token ends (a run of white space gives its last one back).
AHEAD = 2


class Counts:
    """Token counts of pre-tokens."""

    def __init__(self, enc: Encoder):
        self.enc = enc

    def learn(self, tokens: set[str]) -> None:
        if len(self.enc.tokens) > 1_000_000:
            self.enc.tokens.clear()
        self.enc._learn_tokens(tokens)

    def of(self, token: str) -> int:
        known = self.enc.tokens
        if token not in known:
            self.enc._learn_tokens({token})
        return len(known[token]) // 4


def cut(text: str) -> list[str]:
    return (PATTERN if _ODD.search(text) else SIMPLE).findall(text)


class Tree:
    """``total`` tokens of the text; ``edit`` changes both."""

    def __init__(self, tokens: list[str], counts: Counts):
        self.counts, self.cut_anew = counts, 0
        self._build(tokens)

    def _build(self, tokens: list[str]) -> None:
        self.blocks = [tokens[i : i + BLOCK] for i in range(0, len(tokens), BLOCK)] or [[]]
        size = 1
        while size < len(self.blocks):
            size *= 2
        self.size, self.chars, self.sums = size, [0] * (2 * size), [0] * (2 * size)
        of = self.counts.of
        for k, block in enumerate(self.blocks):
            self.chars[size + k] = sum(map(len, block))
            self.sums[size + k] = sum(map(of, block))
        for k in range(size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def text(self) -> str:
        return "".join(t for b in self.blocks for t in b)

    def _find(self, at: int) -> tuple[int, int]:
        """Block that holds character ``at`` (the last, if behind the end), and characters before the block."""
        k, before = 1, 0
        if at >= self.chars[1]:
            last = len(self.blocks) - 1
            return last, self.chars[1] - self.chars[self.size + last]
        while k < self.size:
            k *= 2
            if at - before >= self.chars[k]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def _set(self, k: int, block: list[str]) -> None:
        self.blocks[k] = block
        k += self.size
        chars, tokens = sum(map(len, block)) - self.chars[k], sum(map(self.counts.of, block)) - self.sums[k]
        while k:
            self.chars[k] += chars
            self.sums[k] += tokens
            k //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end`` (exclusive) of the text by ``new``; out of range, up to its end."""
        n = self.chars[1]
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        first, at = self._find(max(0, start - AHEAD))
        i = 0
        while i < len(self.blocks[first]) and at + len(self.blocks[first][i]) + AHEAD <= start:
            at += len(self.blocks[first][i])
            i += 1
        # old pre-tokens from here on, read as far as needed
        last, j, old, cuts, done = first, i, [], [], at

        def more() -> bool:
            nonlocal last, j, done
            while last + 1 < len(self.blocks) and j >= len(self.blocks[last]):
                last, j = last + 1, 0
            if j >= len(self.blocks[last]):
                return False
            token = self.blocks[last][j]
            old.append(token)
            done += len(token)
            cuts.append(done)
            j += 1
            return True

        while done < end + AHEAD + 1 and more():
            pass
        shift = len(new) - (end - start)
        text = "".join(old)
        text = text[: start - at] + new + text[end - at :]
        fresh, p, ahead = [], 0, 0
        while True:
            # a cut behind the edit that is an old one ends it
            if p >= start - at + len(new):
                here = p + at - shift
                while ahead < len(cuts) and cuts[ahead] < here:
                    ahead += 1
                if ahead < len(cuts) and cuts[ahead] == here:
                    keep = old[ahead + 1 :]
                    break
            if p >= len(text):
                if not more():
                    keep = []
                    break
                text += old[-1]
                continue
            m = PATTERN.match(text, p)
            # too near to the end of what was read to be sure
            if m.end() + AHEAD > len(text) and more():
                text += old[-1]
                continue
            fresh.append(m.group())
            p = m.end()
        self.cut_anew += len(fresh)
        head, tail = self.blocks[first][:i], keep + self.blocks[last][j:]
        for k in range(first + 1, last + 1):
            self._set(k, [])
        self._set(first, head + fresh + tail)
        if len(self.blocks[first]) > FULL:
            self._build([t for b in self.blocks for t in b])


def count_edited(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Token counts of ``docs(doc_id, text, edits)`` before and after the edits, made one after the other.

    ``edits`` is an array of ``(start, end, text)`` in code points of the text as it is then. Returns ``doc_id,
    n_tokens, n_tokens_after, n_pretokens, n_cut_anew``. Null and empty texts have no tokens before, null arrays
    no edits, null edits or null parts of one count as 0 or empty; repeated rows and null ids are rows of their
    own; an empty table gives no rows; other columns are not read. One pass, no shuffle.
    """

    def run(batches):
        counts = Counts(encoder(tokenizer))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            edits = batch.column(2).to_pylist()
            rows = []
            for at, some in chunks(texts):
                tokens = [cut(x) for x in some]
                counts.learn({t for ts in tokens for t in ts})
                for k, ts in enumerate(tokens):
                    tree = Tree(ts, counts)
                    before = tree.total
                    for e in edits[at + k] or ():
                        if e:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                    rows.append((before, tree.total, len(ts), tree.cut_anew))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))], ["doc_id", "n_tokens", "n_tokens_after", "n_pretokens", "n_cut_anew"])

    return docs.select(F.col("doc_id").cast("long"), "text", "edits").mapInArrow(run, "doc_id long, n_tokens long, n_tokens_after long, n_pretokens long, n_cut_anew long")


def edits_of(text: Column) -> Column:
    """Three edits that depend on a text's length alone: a replacement, an insertion and a cut at the end."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    third = F.floor(n / 3).cast("int")

    def one(start, end, new):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("text"))

    return F.array(one(third, third + 7, " edited in 2024"), one(2 * third, 2 * third, "they'll  see "), one(n - 11, n + 100, ""))
