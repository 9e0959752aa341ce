"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts are gathered into one cell for each combination of the dimensions' values; raking scales the cells to the target of
one dimension after another until all hold; documents are then sampled with the calibrated probability of their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.spread import settle

WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
#: Sweeps at most, and the gap of shares at which raking has settled.
SWEEPS, TOLERANCE = 3000, 1e-10


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, n: int = 8) -> Column:
    """A stand-in for a topic model where the table has no topic: one of ``n`` classes by a digest of the first word."""
    word = F.translate(F.regexp_extract(F.coalesce(text, F.lit("")), WORD, 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit("t"), F.pmod(F.conv(F.substr(F.md5(word), F.lit(1), F.lit(4)), 16, 10).cast("int"), F.lit(n)).cast("string"))


def uniform(id_: Column, seed: str) -> Column:
    """A number in [0, 1) that only the id and the seed decide."""
    digest = F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(seed)))
    return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def key_of(value: Column) -> Column:
    """A dimension's value as a string that a null and no other value has as its own: empty for null, else after ``=``."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``cells(dimensions…, tokens)`` with ``w``: the tokens scaled so that each dimension's shares are its target's; and the
    largest gap that is left between a share and its target.

    targets: for each dimension a table ``(value, share)``; shares sum to 1 over the values that occur. A value without
    a row, or of share 0, gets weight 0. Each step is a windowed sum over the cells, which are as many as
    combinations of values, not as documents; three sweeps make one plan, whose result is written to the shared folder.

    It ends when the gap is below ``tolerance``, or when it has stopped falling (by a hundredth in thirty sweeps), as it does where
    targets can't all hold because too few combinations occur; the last dimension's targets hold then, the others' as nearly
    as the gap says. After ``sweeps`` sweeps the gap is returned as it is.
    """
    dims = list(targets)
    at = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in dims:
        at = at.join(targets[d].select(F.col("value").alias(d), F.col("share").alias(f"__{d}")), d, "left").fillna(0.0, [f"__{d}"])
    at = settle(at)
    n = at.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    def step(df: DataFrame, d: str) -> DataFrame:
        have = F.sum("w").over(Window.partitionBy(d))
        return df.withColumn("w", F.when(have > 0, F.col("w") * F.col(f"__{d}") * float(n) / have).otherwise(0.0))

    gaps = [float("inf")]
    for _ in range(0, sweeps, 3):
        for _ in range(3):
            for d in dims:
                at = step(at, d)
        at = settle(at)
        away = [F.abs(F.sum("w").over(Window.partitionBy(d)) / float(n or 1) - F.col(f"__{d}")) for d in dims]
        off = at.select(F.array_max(F.array(*away)).alias("off")).agg(F.max("off")).first()[0] if n else 0.0
        gaps.append(off)
        if off < tolerance or len(gaps) > 11 and off > 0.99 * gaps[-11]:
            break
    return at.drop(*(f"__{d}" for d in dims)), gaps[-1]


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares in proportion to the present ones to a power: below 1, small values gain."""
    by = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
    p = F.pow(F.col("n"), F.lit(power))
    return by.select(F.col(dimension).alias("value"), (p / F.sum(p).over(Window.partitionBy(F.lit(0)))).alias("share"))


def probabilities(cells: DataFrame, fraction: float) -> DataFrame:
    """``prob`` for each cell: in proportion to w / tokens, at most 1, so that the expected tokens are ``fraction`` of all.

    Cells at 1 leave their part of the budget to the others; each step adds a cell to them, so it settles. Where cells of weight 0
    hold more than the rest of the tokens, all others are at 1 and the expected tokens fall short of ``fraction``.
    """
    n = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    scale = fraction
    while True:
        full = (F.col("tokens") > 0) & (F.col("w") * scale >= F.col("tokens"))
        r = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("rest")).first()
        now = (fraction * n - float(r["full"] or 0)) / r["rest"] if r["rest"] and r["rest"] > 0 else scale
        if now <= scale * (1 + 1e-12):
            break
        scale = now
    return cells.withColumn("prob", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("w") * scale / F.col("tokens"))).otherwise(0.0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = DIMENSIONS, targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, fraction: float = 0.5, seed: str = "mix", keep_all: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs`` with id, the dimensions, n_tokens, weight (raked tokens over tokens of the cell), prob and sampled.

    targets: shares by dimension and value (null: present token shares to the power ``power``). Given targets that can't all hold
    with the combinations that occur are refused with the gap that is left; the default ones are met as nearly as can be, and
    target_gap (the same in each row, rounded to six digits) says how nearly. Where ``docs`` has no
    column topic, ``topic_of`` gives one. A null value of a dimension is a value of its own. A document without tokens weighs nothing: its probability
    is its cell's. keep_all=False returns only what was sampled. carry: more columns to keep; none may be
    named like the results. An empty table gives no rows.
    """
    taken = {"n_tokens", "weight", "prob", "sampled", "target_gap"}
    if clash := taken & {*carry, *dimensions, id_col}:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    own = docs if "topic" in docs.columns or "topic" not in dimensions else docs.withColumn("topic", topic_of(F.col(text_col)))
    base = own.select(*dict.fromkeys([id_col, *carry]), *(own[d].alias(d) for d in dimensions if d not in (id_col, *carry)), token_count(own[text_col]).alias("n_tokens"))
    keyed = base.withColumns({f"__k_{d}": key_of(F.col(d)) for d in dimensions})
    cells = settle(keyed.groupBy(*(F.col(f"__k_{d}").alias(d) for d in dimensions)).agg(F.sum("n_tokens").alias("tokens")))
    spark = docs.sparkSession

    def target(d: str) -> DataFrame:
        if not targets or d not in targets:
            return tempered(cells, d, power)
        given = spark.createDataFrame([("" if k is None else f"={k}", float(v)) for k, v in targets[d].items()], "value string, share double")
        present = given.join(cells.where("tokens > 0").select(F.col(d).alias("value")).distinct(), "value")
        return present.select("value", (F.col("share") / F.sum("share").over(Window.partitionBy(F.lit(0)))).alias("share"))

    scaled, gap = rake(cells, {d: target(d) for d in dimensions})
    if targets and gap > 1e-6:
        raise ValueError(f"the targets can't all hold with the combinations that occur: a share stays {gap:.3g} off")
    raked = settle(probabilities(scaled, fraction))
    table = raked.select(*(F.col(d).alias(f"__k_{d}") for d in dimensions), F.round(F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0), 6).alias("weight"), "prob")
    out = keyed.join(table, [f"__k_{d}" for d in dimensions], "left").drop(*(f"__k_{d}" for d in dimensions))
    out = out.withColumn("sampled", uniform(F.col(id_col), seed) < F.col("prob")).withColumn("prob", F.round("prob", 6)).withColumn("target_gap", F.lit(round(gap, 6)))
    return out if keep_all else out.where("sampled")
