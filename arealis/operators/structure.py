"""Space-time structure matrices as coordinate tables ``(i, j, v)``.

Indices are 0-based. Area index runs fastest: element = year * n + area.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def laplacian(edges: DataFrame, areas: DataFrame | None = None, area: str = "geom") -> DataFrame:
    """Degree matrix minus adjacency from directed edges (i, j).

    ``areas`` adds a zero diagonal for isolated areas.
    """
    off = edges.select("i", "j", F.lit(-1.0).alias("v"))
    diag = edges.groupBy("i").agg(F.count(F.lit(1)).cast("double").alias("v"))
    if areas is not None:
        diag = areas.select(F.col(area).alias("i")).join(diag, "i", "left").fillna(0.0, ["v"])
    return off.unionByName(diag.select("i", F.col("i").alias("j"), "v"))


def rw1(spark: SparkSession, t: int) -> DataFrame:
    """First-order random-walk structure over ``t`` periods (path Laplacian)."""
    i = F.col("id")
    degree = F.when(F.lit(t == 1), F.lit(0.0)).when((i == 0) | (i == t - 1), F.lit(1.0)).otherwise(F.lit(2.0))
    row = F.array(
        F.struct((i - 1).alias("j"), F.lit(-1.0).alias("v")),
        F.struct(i.alias("j"), degree.alias("v")),
        F.struct((i + 1).alias("j"), F.lit(-1.0).alias("v")),
    )
    return (
        spark.range(t)
        .select(i.alias("i"), F.explode(row).alias("e"))
        .select("i", "e.j", "e.v")
        .where((F.col("j") >= 0) & (F.col("j") < t) & (F.col("v") != 0))
    )


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def ones(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    k = F.col("id")
    return spark.range(rows * cols).select(
        F.floor(k / cols).alias("i"), F.pmod(k, F.lit(cols)).alias("j"), F.lit(1.0).alias("v")
    )


def kron(a: DataFrame, b: DataFrame, b_rows: int, b_cols: int) -> DataFrame:
    """Kronecker product: ``(ia*rows + ib, ja*cols + jb, va*vb)``.

    Every pair of entries is part of the result. It runs as a hash join on a
    salt: the factor with more entries is spread over the salts and the other one
    goes to each, so the pairs of one task are bounded, only the smaller factor is
    copied, and no cartesian product is planned.
    """
    na, nb = a.count(), b.count()
    salts = max(1, min(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(na, nb)))
    spread = F.pmod(F.hash("i", "j"), F.lit(salts)).alias("_salt")
    copied = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    left = a.select(F.col("i").alias("ia"), F.col("j").alias("ja"), F.col("v").alias("va"), spread if na > nb else copied)
    right = b.select(F.col("i").alias("ib"), F.col("j").alias("jb"), F.col("v").alias("vb"), copied if na > nb else spread)
    return left.join(right, "_salt").select(
        (F.col("ia") * b_rows + F.col("ib")).alias("i"),
        (F.col("ja") * b_cols + F.col("jb")).alias("j"),
        (F.col("va") * F.col("vb")).alias("v"),
    )


INTERACTION_TYPES = ("I", "II", "III", "IV")


def _temporal_block(spatial: DataFrame, t: int) -> DataFrame:
    """``rw1 (x) spatial`` by an explode over years; no join is needed because the
    random-walk row of a year is known."""
    k = F.col("k")
    degree = F.when(F.lit(t == 1), F.lit(0.0)).when((k == 0) | (k == t - 1), F.lit(1.0)).otherwise(F.lit(2.0))
    return (
        spatial.select("i", "j", "v", F.explode(F.sequence(F.lit(0), F.lit(t - 1))).alias("k"))
        .select(
            "i",
            "j",
            "v",
            "k",
            F.explode(
                F.array(
                    F.struct((k - 1).alias("l"), F.lit(-1.0).alias("r")),
                    F.struct(k.alias("l"), degree.alias("r")),
                    F.struct((k + 1).alias("l"), F.lit(-1.0).alias("r")),
                )
            ).alias("e"),
        )
        .select("i", "j", "v", "k", "e.l", "e.r")
        .where((F.col("l") >= 0) & (F.col("l") < t) & (F.col("r") != 0))
    )


def interaction(kind: str, spatial: DataFrame, n: int, t: int) -> tuple[DataFrame, int]:
    """Space-time precision of interaction type I-IV and its rank deficiency.

    ``spatial`` is the Laplacian of the area graph over indices 0..n-1.
    I: identity; II: random walk in time for each area; III: spatial structure
    for each year; IV: both.
    """
    if kind not in INTERACTION_TYPES:
        raise ValueError("kind must be I, II, III or IV")
    spark = spatial.sparkSession
    if kind == "I":
        return identity(spark, n * t), 0
    if kind == "III":
        k = F.explode(F.sequence(F.lit(0), F.lit(t - 1))).alias("k")
        out = spatial.select("i", "j", "v", k).select(
            (F.col("k") * n + F.col("i")).alias("i"), (F.col("k") * n + F.col("j")).alias("j"), "v"
        )
        return out, t
    block = _temporal_block(identity(spark, n) if kind == "II" else spatial, t)
    out = block.select(
        (F.col("k") * n + F.col("i")).alias("i"),
        (F.col("l") * n + F.col("j")).alias("j"),
        (F.col("v") * F.col("r")).alias("v"),
    )
    return out, n if kind == "II" else n + t - 1


def constraints(spark: SparkSession, kind: str, n: int, t: int) -> DataFrame:
    """Sum-to-zero constraints of an interaction: 1, n, t or n-1+t rows."""
    if kind not in INTERACTION_TYPES:
        raise ValueError("kind must be I, II, III or IV")
    cell = spark.range(n * t).select(F.col("id").alias("j"), F.pmod("id", F.lit(n)).alias("area"), F.floor(F.col("id") / n).alias("k"))
    one = F.lit(1.0).alias("v")
    if kind == "I":
        return cell.select(F.lit(0).cast("long").alias("i"), "j", one)
    by_area = cell.select(F.col("area").alias("i"), "j", one)
    by_year = cell.select(F.col("k").alias("i"), "j", one)
    if kind == "II":
        return by_area
    if kind == "III":
        return by_year
    # the first area's row follows from the others and is left out
    return by_area.where(F.col("i") > 0).select((F.col("i") - 1).alias("i"), "j", "v").unionByName(
        by_year.select((F.col("i") + n - 1).alias("i"), "j", "v")
    )


def linear_combinations(blocks: Mapping[str, DataFrame]) -> DataFrame:
    """Selectors ``(effect, i, j, v)`` from one coordinate table per effect."""
    out = None
    for name, m in blocks.items():
        part = m.select(F.lit(name).alias("effect"), "i", "j", "v")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("at least one block is needed")
    return out


def area_selectors(spark: SparkSession, n: int, t: int, slope: str, interaction_effect: str, year_effect: str | None = None) -> DataFrame:
    """Selectors of the varying slope: per (year, area) the area slope plus the
    interaction, and optionally the year slope."""
    cell = spark.range(n * t).select(F.col("id").alias("i"), F.pmod("id", F.lit(n)).alias("area"), F.floor(F.col("id") / n).alias("k"))
    one = F.lit(1.0).alias("v")
    blocks = {
        slope: cell.select("i", F.col("area").alias("j"), one),
        interaction_effect: cell.select("i", F.col("i").alias("j"), one),
    }
    if year_effect:
        blocks[year_effect] = cell.select("i", F.col("k").alias("j"), one)
    return linear_combinations(blocks)


def multiply(m: DataFrame, x: DataFrame, index: str = "j", value: str = "x") -> DataFrame:
    """Matrix times vector: ``(i, y)`` from entries and a table (index, value)."""
    vec = x.select(F.col(index).alias("j"), F.col(value).alias("_x"))
    return m.join(vec, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("y"))
