"""Corpora, word lists, rules, cases and models as files."""

from __future__ import annotations

import json
import re
import zlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_line, confusable


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of text files, cleaned, blank ones left out."""
    return spark.read.text(path).select(clean_line(F.col("value")).alias("line")).where("line <> ''")


def wordlist(spark: SparkSession, path: str) -> DataFrame:
    return corpus(spark, path).select(F.lower(F.trim("line")).alias("word")).distinct()


def vocabulary_text(spark: SparkSession, path: str) -> DataFrame:
    """``token, id`` of lines whose last field is the id; tokens may hold spaces."""
    x = spark.read.text(path).where(F.col("value").rlike(r"^.*\S\s+\d+\s*$"))
    return x.select(F.regexp_extract("value", r"^(.*\S)\s+(\d+)\s*$", 1).alias("token"), F.regexp_extract("value", r"^(.*\S)\s+(\d+)\s*$", 2).cast("int").alias("id"))


def seed_yaml(spark: SparkSession, path: str) -> DataFrame:
    """``seed`` of the list items of a YAML file, without look-alikes from other scripts."""
    x = spark.read.text(path).select(F.regexp_extract("value", r"^\s*-\s+[\"']?([^\"'#]+?)[\"']?\s*(?:#.*)?$", 1).alias("seed"))
    return x.where((F.col("seed") != "") & ~confusable(F.col("seed")))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """``context (array), prefix, expected, category, difficulty`` with the defaults ``general`` and 0.5."""
    x = spark.read.csv(path, header=True, schema="context string, prefix string, expected string, category string, difficulty double")
    return x.select(F.split(F.trim("context"), r"\s+").alias("context"), F.coalesce("prefix", F.lit("")).alias("prefix"), "expected", F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("difficulty", F.lit(0.5)).alias("difficulty"))


RULES = "vocab_size int, rules array<struct<candidate_token:int,context_token:int,modifier:double,rule_mask:bigint>>"


def json_rules(spark: SparkSession, path: str) -> DataFrame:
    """``candidate, context, modifier, rule_mask``; hexadecimal numbers are allowed; candidates beyond the vocabulary go."""
    text = spark.read.text(path, wholetext=True).select("value")
    hexes = F.transform(F.regexp_extract_all("value", F.lit(r"0x([0-9a-fA-F]+)"), 1), lambda h: h)
    fixed = F.aggregate(hexes, F.col("value"), lambda s, h: F.regexp_replace(s, F.concat(F.lit("0x"), h, F.lit(r"\b")), F.conv(h, 16, 10)))
    x = text.select(F.from_json(fixed, RULES).alias("j")).select("j.vocab_size", F.explode("j.rules").alias("r"))
    return x.where("r.candidate_token < vocab_size").select(F.col("r.candidate_token").alias("candidate"), F.col("r.context_token").alias("context"), F.coalesce("r.modifier", F.lit(1.0)).alias("modifier"), F.coalesce("r.rule_mask", F.lit(0)).alias("rule_mask"))


def pack_mask(require: Column, add: Column, clear: Column) -> Column:
    """Three 20-bit masks as one number."""
    return F.shiftleft(clear.cast("long"), 40).bitwiseOR(F.shiftleft(add.cast("long"), 20)).bitwiseOR(require.cast("long"))


def compiled(rules: DataFrame) -> DataFrame:
    """Rules in the order and precision of a compiled table: by candidate, modifiers in steps of 1/256."""
    q = (F.floor(F.col("modifier") * 256 + 0.5) / 256).alias("modifier")
    return rules.select("candidate", "context", q, "rule_mask").repartition("candidate").sortWithinPartitions("candidate", "context")


def save_model(tables: dict[str, DataFrame], path: str) -> dict:
    """Write the tables of a model as parquet beside a manifest with their rows and checksums; the manifest comes last."""
    root = Path(path.removeprefix("file://"))
    manifest = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest[name] = _summary(df.sparkSession.read.parquet(f"{path}/{name}"))
    text = json.dumps({"version": 1, "tables": manifest}, sort_keys=True)
    part = root / "manifest.part"
    part.write_text(json.dumps({"crc32": zlib.crc32(text.encode()), "body": text}))
    part.rename(root / "manifest.json")
    return manifest


def _summary(df: DataFrame) -> dict:
    n, h = df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0))).first()
    return {"rows": n, "hash": h, "schema": df.schema.simpleString()}


def load_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a model; raises ValueError if the manifest or a table isn't what was saved."""
    try:
        outer = json.loads((Path(path.removeprefix("file://")) / "manifest.json").read_text())
        if zlib.crc32(outer["body"].encode()) != outer["crc32"]:
            raise ValueError("checksum")
        tables = json.loads(outer["body"])["tables"]
    except (OSError, KeyError, TypeError, json.JSONDecodeError) as e:
        raise ValueError(f"no valid manifest in {path}") from e
    found = {}
    for name, want in tables.items():
        df = spark.read.parquet(f"{path}/{name}")
        if _summary(df) != want:
            raise ValueError(f"table {name} isn't what was saved")
        found[name] = df
    return found


def export(df: DataFrame, path: str, kind: str) -> None:
    """Results as json, csv, txt (tab-separated), yaml (one item a row) or parquet."""
    w = df.write.mode("overwrite")
    if kind == "json":
        w.json(path)
    elif kind == "csv":
        w.option("header", True).csv(path)
    elif kind == "parquet":
        w.parquet(path)
    elif kind in ("txt", "yaml"):
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
        line = F.concat_ws("\t", *cells) if kind == "txt" else F.concat(F.lit("- {"), F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)) for c in df.columns)), F.lit("}"))
        df.select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def benchmark_tsv(spark: SparkSession, path: str) -> DataFrame:
    names = "case_name string, expected int, bytes int, tokens int, avg_len double, tokens_per_ms double, fast_path_pct double, fast_hits long, traversals long, utf8_skips long, cycles_per_token double, description string"
    return spark.read.csv(path, sep="\t", header=True, schema=names).na.drop(subset=["case_name", "tokens"])


def grammar_yaml(text: str, tags: dict[str, int]) -> list[tuple[str, str, float, int]]:
    """(candidate, context, modifier, mask) of a small YAML rule list; masks from tag names by bit."""
    rows = []
    for block in re.split(r"(?m)^\s*-\s+(?=candidate:)", text)[1:]:
        own = dict(re.findall(r"(?m)^\s*(\w+):\s*(.+?)\s*$", block))

        def mask(key, own=own):
            return sum(1 << tags[t] for t in re.findall(r"\w+", own.get(key, "")))

        rows.append((own["candidate"].strip("\"'"), own.get("context", "").strip("\"'"), float(own.get("modifier", 1)), mask("clear") << 40 | mask("add") << 20 | mask("require")))
    return rows
