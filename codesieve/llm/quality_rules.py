"""Host-level quality rules: failures of each rule by host, shrunk by an empirical beta prior, joined back to the documents.

A document that fails a base rule goes. Soft rules have a usual limit and a strict one, and the posterior of the document's host decides which holds:
the strict one where the host's rate for the rule, or for the base rules, lies above the prior's mean by SUSPECT prior deviations, the usual one elsewhere, and
none where the host all but never fails the rule. A host whose documents mostly fail, beyond doubt after shrinking, is condemned with all that is on it.
Where hosts hardly differ, the fitted prior is narrow, posteriors lie close to it, and few documents are judged by the strict limits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, slices, stash

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
#: rule -> SQL of its failure over the counts (n_lines: lines with a word), and by the strict limit. Integers only, so every engine agrees.
SOFT = {
    "symbols": ("10 * n_symbols > n_words", "25 * n_symbols > n_words"),
    "lines": ("n_dup_lines > 3 AND 2 * n_dup_lines > n_lines", "n_dup_lines > 1 AND 4 * n_dup_lines > n_lines"),
    "repeats": ("100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words > 20 * n_words"),
    "length": ("n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)", "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words)"),
}
BASE = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"
#: A host below this shrunk rate of a rule keeps the few documents that fail it; one surely above CONDEMNED loses all; one above the prior by SUSPECT deviations is judged strictly.
TOLERATED = 0.001
CONDEMNED = 0.5
SUSPECT = 0.5


def counts(text: str) -> tuple[int, int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = dup = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line.strip(_SPACES):
                lines += 1
                dup += line in seen
                seen.add(line)
    else:
        lines = int(bool(words))
    repeat, n = 0, len(words)
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < n - 2:
            times = Counter(windows)
            last = 0  # the first place that isn't counted yet
            for k, w in enumerate(windows):
                if times[w] > 1:
                    repeat += k + 3 - max(k, last)
                    last = k + 3
    return n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), dup, repeat, lines


_ROW = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *[(c, pa.int64()) for c in (*COUNTS, "n_lines")]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = [counts(t or "") for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *[pa.array(c, pa.int64()) for c in zip(*rows)]], schema=_ROW)


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) for each row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count, "doc_id long, host string, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_lines")))


def _rules() -> dict[str, str]:
    return {"base": BASE, **{r: usual for r, (usual, _) in SOFT.items()}}


def host_rates(stats: DataFrame, suspect: float = SUSPECT) -> DataFrame:
    """(host, n_docs, and for each rule rate_<rule>, sd_<rule>, suspect_<rule>): posterior mean and deviation of the failure rate under a beta prior
    fitted to all hosts by moments, and whether the mean is above the prior's by so many prior deviations."""
    per = stats.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.count_if(F.expr(sql)).alias(f"k_{r}") for r, sql in _rules().items()])
    per = stash(per, "hosts")
    moments = []
    for r in _rules():
        rate = F.col(f"k_{r}") / F.col("n_docs")
        moments += [(F.sum(f"k_{r}") / F.sum("n_docs")).alias(f"m_{r}"), F.var_pop(rate).alias(f"v_{r}")]
    m = per.agg(*moments, F.count("*").alias("hosts"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    columns = ["host", "n_docs"]
    for r in _rules():
        mean, var = m[f"m_{r}"] or 0.0, m[f"v_{r}"] or 0.0
        between = max(var - mean * (1 - mean) * (m["inv"] or 0.0), 1e-6)  # without what chance alone spreads
        strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1000.0)
        a, b = max(mean * strength, 1e-3), max((1 - mean) * strength, 1e-3)
        p = (F.col(f"k_{r}") + a) / (F.col("n_docs") + a + b)
        high = a / (a + b) + suspect * math.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
        columns += [p.alias(f"rate_{r}"), F.sqrt(p * (1 - p) / (F.col("n_docs") + a + b + 1)).alias(f"sd_{r}"), (p > high).alias(f"suspect_{r}")]
    return per.select(*columns)


def judge(docs: DataFrame, *, tolerated: float = TOLERATED, condemned: float = CONDEMNED, suspect: float = SUSPECT, **columns) -> DataFrame:
    """(doc_id, host, the counts, base_failed, soft_failed, strict_failed, host_suspect, host_condemned, kept) for each row of docs.

    soft_failed: by a usual limit that holds on the host; strict_failed: by a strict one; host_suspect: some strict limit holds on the host. A null or empty
    text has no words and fails the base rules; a null host is a host of its own. Repeated rows are judged alike and count for their
    host as often as they are there. Other columns aren't read. An empty table gives none.
    """
    stats = stash(statistics(docs, **columns), "rule-counts")
    rates = stash(host_rates(stats, suspect), "host-rates")  # of known size: broadcast only under Spark's threshold
    bad = F.greatest(*[F.col(f"rate_{r}") - 2 * F.col(f"sd_{r}") for r in _rules()]) > condemned
    soft, strict, some = F.lit(False), F.lit(False), F.col("suspect_base")
    for r, (usual, closer) in SOFT.items():
        soft = soft | (F.expr(usual) & (F.col(f"rate_{r}") > tolerated))
        strict = strict | (F.expr(closer) & (F.col("suspect_base") | F.col(f"suspect_{r}")))
        some = some | F.col(f"suspect_{r}")
    judged = stats.join(rates.withColumnRenamed("host", "__h"), F.col("host").eqNullSafe(F.col("__h")))
    base = F.expr(BASE)
    verdict = ~(base | soft | strict | bad)
    return judged.select("doc_id", "host", *COUNTS, base.alias("base_failed"), soft.alias("soft_failed"), strict.alias("strict_failed"), some.alias("host_suspect"), bad.alias("host_condemned"), verdict.alias("kept"))
