"""Quality rules for texts, and verdicts on whole hosts from shrunken failure rates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import Staged, claim

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: rules that decide about a document by itself
BASE_RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
#: rules that only count towards the rate of a host, with the base rules
HOST_RULES = {"symbols": "10 * n_symbols > n_words", "lines": "20 * n_dup_lines > n_words",
              "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words"}


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of a whole text in the order of ``MEASURES``; null counts as empty."""
    text = text or ""
    words = _WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(_WORD.search(line))
        seen.add(line)
    repeat = 0
    if len(words) >= 3:
        names: dict[str, int] = {}
        w = np.fromiter((names.setdefault(x, len(names)) for x in words), np.int64, len(words))
        pair = np.unique(w[:-1] * len(names) + w[1:], return_inverse=True)[1]
        _, window, count = np.unique(pair[:-1] * len(names) + w[2:], return_inverse=True, return_counts=True)
        again = count[window] > 1
        inside = np.zeros(len(words), bool)
        for i in range(3):
            inside[i:len(words) - 2 + i] |= again
        repeat = int(inside.sum())
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim(__name__)
    for batch in batches:
        made = list(zip(*(measure(t.as_py()) for t in batch.column(2)))) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in made)],
                                         names=["id", "host", *MEASURES])


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, docs, rate_<rule>...): failure rates shrunken towards the rate of all hosts.

    The prior of a rule is a beta distribution with the mean of all documents,
    whose strength is fitted by moments: the variance of the hosts' raw rates
    less what chance alone would give. A host with few documents is judged
    mostly by the prior, one with many by itself. Where the rates vary no more
    than by chance, all hosts get the common rate.
    """
    rules = {**BASE_RULES, **HOST_RULES}
    hosts = measured.where("host is not null").groupBy("host").agg(
        F.count("*").alias("docs"), *[F.sum(F.expr(x).cast("long")).alias(f"fails_{r}") for r, x in rules.items()])
    sums = [F.sum("docs").alias("n"), F.count("*").alias("k"), F.sum(F.col("docs") * F.col("docs")).alias("n2")]
    for r in rules:
        sums += [F.sum(f"fails_{r}").alias(f"f_{r}"),
                 F.sum(F.col(f"fails_{r}").cast("double") * F.col(f"fails_{r}") / F.col("docs")).alias(f"q_{r}")]
    whole = hosts.agg(*sums)  # one row
    out = hosts.join(F.broadcast(whole))
    rates = []
    for r in rules:
        mean = f"(f_{r} / n)"
        spread = f"(q_{r} - n * {mean} * {mean})"  # between hosts, weighted by documents
        scale = "(n - n2 / n)"
        variance = f"(({spread} - (k - 1) * {mean} * (1 - {mean})) / ({scale} - (k - 1)))"
        # strength a + b of the beta prior; without more spread than chance the prior decides alone
        strength = (f"CASE WHEN k > 1 AND {scale} > k - 1 AND {variance} > 0 "
                    f"THEN greatest({mean} * (1 - {mean}) / {variance} - 1, 0) END")
        rates.append(F.expr(f"coalesce((fails_{r} + {mean} * {strength}) / (docs + {strength}), {mean})").alias(f"rate_{r}"))
    return out.select("host", "docs", *rates)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_rate: float = 0.5) -> DataFrame:
    """(id, measures, base_failed, host_failed, kept) for every row of ``docs``.

    A document fails by a base rule, or because its host's shrunken failure
    rate of any rule is above ``max_rate``: then most of the host is junk. A
    host's documents are counted map-side, so one that holds a third of all
    rows costs a row a task; its verdict is joined back.

    Null texts have no words and fail; null hosts get no host verdict; repeated
    rows count as often as they come. An empty table gives no rows. Other
    columns are ignored.
    """
    schema = "id long, host string, " + ", ".join(f"{m} long" for m in MEASURES)
    source = docs.select(F.col(id_col).cast("long"), F.col(host_col).cast("string"), F.col(text_col))
    measured = Staged(docs.sparkSession, "quality")(source.mapInArrow(_measure, schema), "measured")
    failed = " or ".join(f"rate_{r} > {max_rate}" for r in (*BASE_RULES, *HOST_RULES))
    verdicts = host_rates(measured).select("host", F.expr(failed).alias("host_failed"))
    out = measured.join(verdicts, "host", "left").select(
        "id", "host", *MEASURES, F.expr(" or ".join(f"({x})" for x in BASE_RULES.values())).alias("base_failed"),
        F.coalesce("host_failed", F.lit(False)).alias("host_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).withColumnRenamed("id", id_col)
