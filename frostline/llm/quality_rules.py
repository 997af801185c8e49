"""Host-level quality rules: failures by host, shrunk with an empirical beta prior, joined back to documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.text import SEPARATORS, WordHashes, window_hashes, words
from frostline.sources.shared import written

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rules:
    """A document fails with fewer than min_words words, or over max_repeat_pct % of its words in repeated windows.

    A host fails when its shrunk failure rate is over max_host_rate.
    """

    min_words: int = 10
    max_repeat_pct: int = 20
    max_host_rate: float = 0.5


def measure(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    tokens = raw.split()
    chars = len(text) - sum(map(text.count, SEPARATORS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    seen = window_hashes(hashes.of(tokens), WINDOW)
    repeated = 0
    if len(seen) > 1:
        order = np.argsort(seen, kind="stable")
        ranked = seen[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            again = np.zeros(len(seen), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            starts = np.flatnonzero(again)
            steps = np.zeros(len(tokens) + 1, np.int64)
            steps[starts] += 1
            np.subtract.at(steps, starts + WINDOW, 1)
            repeated = int((np.cumsum(steps)[:-1] > 0).sum())
    return len(tokens), chars, symbols, len(lines) - len(set(lines)), repeated


def _measure_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    names = [part.split()[0] for part in MEASURES.split(", ")]
    for batch in batches:
        rows = [measure(text, hashes) for text in batch["text"]]
        numbers = pd.DataFrame(rows, columns=names, dtype="int64")
        yield pd.concat([batch[["doc_id", "host"]].reset_index(drop=True), numbers], axis=1)


def measured(documents: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The measures of every document: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text")
    )
    return rows.mapInPandas(_measure_batches, f"doc_id long, host string, {MEASURES}")


def host_rates(judged: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_kept. Null is a host of its own.

    The prior is a beta distribution fitted by moments: its mean is the overall failure rate, its strength comes from
    the spread of the hosts' rates beyond what chance explains. Without such spread every host gets the overall rate.
    """
    hosts = written(
        judged.groupBy("host").agg(
            F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
        ),
        "hosts",
    )
    sums = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("n_docs").alias("docs"),
        F.sum("n_failed").alias("failed"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("squares"),
    ).first()
    mean, strength = 0.0, 1e6
    if sums.docs:
        mean = sums.failed / sums.docs
        spread = sums.squares / sums.docs - mean * mean
        excess = spread - (sums.hosts - 1) * mean * (1 - mean) / sums.docs
        if excess > 1e-12:
            strength = min(max(mean * (1 - mean) / excess - 1, 1.0), 1e6)
    shrunk = (F.col("n_failed") + F.lit(strength * mean)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"),
                        (shrunk <= F.lit(rules.max_host_rate)).alias("host_kept"))


def apply_rules(
    documents: DataFrame, rules: Rules = Rules(), host: str = "source", text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per document row: its measures, base_failed, the host's shrunk_rate, and kept.

    Null and empty texts have no words and fail. Repeated rows are judged each. An empty table gives no rows.
    Other columns of the input don't matter. The texts are read once; the measures are written as a table, because
    the hosts' rates and the verdicts both need them.
    """
    failed = (F.col("n_words") < rules.min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(rules.max_repeat_pct) * F.col("n_words")
    )
    judged = written(measured(documents, host, text, doc_id).withColumn("base_failed", failed), "measures")
    hosts = host_rates(judged, rules).withColumnRenamed("host", "of_host")
    return judged.join(hosts, judged["host"].eqNullSafe(hosts["of_host"]), "left").select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "shrunk_rate",
    )
