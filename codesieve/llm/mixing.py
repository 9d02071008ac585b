"""Mixing sources to target weights by the cube method.

A document of a source with target t and size s is wanted m = t/s times: floor(m) times for sure, and once more
with the inclusion probability pi = m - floor(m). The flight phase moves the vector of pi through the null space of two
constraints, so that documents and words keep their totals, until all but two units are 0 or 1. It runs in hashed blocks;
what is left of 2048 blocks makes a block of the next level, up to a single landing problem per source.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WORD, ship, stash, whole, with_rank

BLOCK = 4096
FAN_IN = 2048
EPS = 1e-9
#: Units that the landing problem of a source holds besides the two that a flight leaves: it tries all their subsets.
LANDING = 12


def targets(sizes: DataFrame, share: float = 1.0, repeat: float = 3.0) -> DataFrame:
    """(source, n_docs, source_size, weight, target, sid) of a table (source, size).

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; they split share of all sizes by weight. A target above
    repeat times its source's size stops there, and the excess goes to the others by weight until none is above.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = with_rank(per, F.col("source").asc_nulls_last(), name="sid").withColumn("weight", 1 + F.col("sid") % 3)
    cap, total, level, capped = repeat * F.col("source_size"), None, 0.0, -1
    while True:  # each round is an aggregate over the sources; the level only rises
        at = F.col("weight") * F.lit(level) > cap
        r = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(at, cap)).alias("fixed"), F.sum(F.when(~at, F.col("weight"))).alias("w"), F.count_if(at).alias("n")).first()
        total = share * (r["all"] or 0)
        if r["n"] == capped or not r["w"]:
            break
        capped, level = r["n"], (total - (r["fixed"] or 0)) / r["w"]
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double"))


def flight(pi: list[float], a: tuple[list[float], list[float]], rng: random.Random, units: list[int]) -> None:
    """Moves the pi of these units in place, in the null space of two constraints, until at most two are fractional; a[0] must be positive."""
    first, second = a
    rest: list[int] = []
    for k in units:
        if not 0 < pi[k] < 1:
            continue
        rest.append(k)
        if len(rest) < 3:
            continue
        (a0, a1, a2), (b0, b1, b2) = [first[x] for x in rest], [second[x] for x in rest]
        u = [a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0]
        if max(map(abs, u)) <= EPS * (a0 + a1 + a2) * (abs(b0) + abs(b1) + abs(b2)):
            u = [a1, -a0, 0.0]
        up = min(((1 - pi[x]) / d if d > 0 else -pi[x] / d) for x, d in zip(rest, u) if d)
        down = min((pi[x] / d if d > 0 else (pi[x] - 1) / d) for x, d in zip(rest, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for x, d in zip(rest, u):
            v = pi[x] + step * d
            pi[x] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
        rest = [x for x in rest if 0 < pi[x] < 1]


def land(pi: list[float], a: tuple[list[float], list[float]]) -> None:
    """Settles the fractional units, LANDING + 2 at most, by the subset that comes nearest to the second total, then to the first."""
    units = [k for k, p in enumerate(pi) if 0 < p < 1]
    if not units:
        return
    subsets = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    off = [np.abs(subsets @ np.array([x[k] for k in units]) - sum(x[k] * pi[k] for k in units)) for x in a]
    best = int(np.lexsort((off[0], np.round(off[1])))[0])
    for k, taken in zip(units, subsets[best].tolist()):
        pi[k] = float(taken)


def _block(seed: int):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "mix", "doc_id"], ascending=[False, True, True], ignore_index=True)
        sid, level, block, blocks = (int(pdf[c].iat[0]) for c in ("sid", "level", "block", "blocks"))
        a = pdf["n"].astype(float).tolist(), (pdf["n"] * pdf["size"]).astype(float).tolist()
        pi, units = pdf["pi"].tolist(), list(range(len(pdf)))
        if blocks == 1:  # units of halving sizes wait for the landing, so that it can make up for whatever the flight leaves
            for j in range(LANDING):
                if units:
                    units.remove(min(units, key=lambda k: abs(a[1][k] - a[1][0] / 2**j)))
        flight(pi, a, random.Random(f"{seed}/{sid}/{level}/{block}"), units)
        if blocks == 1:
            land(pi, a)
        pdf["pi"] = pi
        return pdf

    return fly


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.0, repeat: float = 3.0, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, n): how often the mix takes each document.

    Size: words of the text (null or empty: 0). Rows that agree in id, source and size are one unit of n rows that is taken
    as a whole. A null id is an id, a null source a source. A source of size 0 has target 0 and isn't taken. Rows with the same values
    draw the same numbers, so reruns agree. An empty table gives an empty mix. Other columns are neither read nor returned.
    """
    ship(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = stash(sized, "mix-sizes")
    goal = stash(targets(sized, share, repeat), "mix-targets")  # its size is known from here on: it's broadcast only under Spark's threshold
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    m = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("m") + EPS)
    frac = F.col("m") - F.col("whole")
    blocks = F.ceil(F.col("n_docs") / BLOCK).cast("long")
    units = (
        units.join(goal.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
        .withColumn("m", m)
        .withColumn("whole", whole)
        .withColumn("pi", F.when(frac > EPS, frac).otherwise(0.0))
        .withColumn("mix", F.xxhash64("doc_id", "size", F.lit(seed)))
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.shiftright("mix", 7), F.col("blocks")))
        .select("doc_id", "source", "size", "n", "sid", "source_size", "target", "whole", "pi", "mix", "block", "blocks", F.lit(0).alias("level"))
    )
    open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
    units = stash(units, "mix-units")
    done, left, most = [units.where(~open_)], units.where(open_), goal.agg(F.ceil(F.max("n_docs") / BLOCK)).first()[0] or 0
    while most:
        flown = stash(left.groupBy("sid", "block").applyInPandas(_block(seed), left.schema), "mix-flown")
        done.append(flown.where(~open_))
        left = flown.where(open_).withColumn("block", F.floor(F.col("block") / FAN_IN)).withColumn("blocks", F.ceil(F.col("blocks") / FAN_IN)).withColumn("level", F.col("level") + 1).select(*left.columns)
        most = 0 if most == 1 else math.ceil(most / FAN_IN)
    result = done[0]
    for x in done[1:]:
        result = result.unionByName(x)
    return result.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("pi").cast("long")).alias("times"), "n")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns of docs: each row as often as mix() takes it. A repeated row shares its unit's decision.

    docs may have any other columns, whatever their names. Nulls and empty tables are as in mix().
    """
    picked = mix(docs, **options).where("times > 0").select("doc_id", "source", "size", F.col("times").cast("int").alias("times"))
    ids, text, source = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(whole(docs), F.col(ids).alias("i"), F.col(source).cast("string").alias("s"), size.alias("n"))
    joined = rows.join(picked, F.col("i").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("row.*")
