"""Mixing sources to target weights by iterative proportional fitting [native]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Write, materialize, temporary

#: Share of each listed value, or an exponent that tempers the present shares.
Target = dict[str, float] | float

ROUNDS = 10
#: The sample holds the largest share of all tokens at which each listed value can have its weight, less this margin ...
MARGIN = 0.95
#: ... and at least so much: values too scarce even for that are kept whole, and the others take their place.
LEAST_YIELD = 0.1
#: Rounds in which goals beyond what a value holds are cut.
CUTS = 6
SEED = "mix-1"
#: Stands for null in a dimension.
NONE = "\x01none"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def topic_of(text: Column) -> Column:
    """A topic by the form of the text: symbols, figures or prose."""
    body = F.coalesce(text, F.lit(""))
    words = n_words(text)
    return (
        F.when(F.regexp_count(body, F.lit(r"[#*$%&|<>]")) * 20 >= words, "symbols")
        .when(F.regexp_count(body, F.lit(r"[0-9]+")) * 50 >= words, "figures")
        .otherwise("prose")
    )


def uniform_draw(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by seed and id: 52 bits of SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _marginal(cells: DataFrame, dim: str, target: Target) -> DataFrame:
    """(dim value, goal, share): target shares over the values that hold tokens, and present ones; both add up to one.

    Values not listed share what the listed ones leave, by their tokens.  Where
    the listed shares leave nothing, the others, null included, keep their
    present share of the tokens and the listed ones divide the remainder.
    """
    held = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).filter("t > 0")
    if not isinstance(target, dict):
        raw = F.pow(F.col("t").cast("double"), F.lit(float(target)))
    else:
        pairs = [x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))]
        listed = F.element_at(F.create_map(*pairs), F.col(dim)) if pairs else F.lit(None).cast("double")
        free = held.withColumn("w", listed)
        rest = free.agg(F.sum(F.when(F.col("w").isNull(), F.col("t"))).alias("rest"), F.sum("w").alias("share"), F.sum(F.when(F.col("w") > 0, F.col("t"))).alias("listed"))
        left = max(0.0, 1.0 - sum(target.values()))
        held = free.join(F.broadcast(rest))
        if left > 1e-9:
            raw = F.coalesce("w", F.lit(left) * F.col("t") / F.col("rest"))
        else:
            raw = F.coalesce("w", F.col("share") * F.col("t") / F.col("listed"), F.col("t").cast("double"))  # the last where no listed value holds tokens
    weights = held.select(dim, raw.alias("goal"), "t")
    total = weights.agg(F.sum("goal").alias("all"), F.sum("t").alias("tokens"))  # one row
    shares = weights.join(F.broadcast(total)).select(dim, (F.col("goal") / F.col("all")).alias("goal"), (F.col("t") / F.col("tokens")).alias("share"))
    return shares.filter("goal > 0")


def _yield(goals: dict[str, DataFrame], targets: dict[str, Target], least: float) -> float:
    """The share of all tokens that the sample holds; one row for each dimension with listed values."""
    listed = [goals[d].agg(F.min(F.col("share") / F.col("goal"))).first()[0] for d, t in targets.items() if isinstance(t, dict)]
    return max(least, min([1.0, *[MARGIN * x for x in listed if x is not None]]))


def _available(goals: DataFrame, part: float) -> DataFrame:
    """Goals cut to what a value holds at this yield; the others grow in proportion."""
    cap, goal = F.col("share") / F.lit(part), F.col("goal")
    for _ in range(CUTS):
        over, held, free = goals.agg(
            F.count(F.when(goal > cap, 1)), F.coalesce(F.sum(F.when(goal >= cap, cap)), F.lit(0.0)), F.sum(F.when(goal < cap, goal))
        ).first()
        if not over:
            break
        goals = goals.withColumn("goal", F.when(goal >= cap, cap).otherwise(goal * F.lit((1.0 - held) / free if free else 0.0)))
    return goals


def rake(cells: DataFrame, targets: dict[str, Target], rounds: int = ROUNDS, least_yield: float = LEAST_YIELD) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Cells with ``probability``, and for each dimension (value, goal, share, reached).

    ``cells`` has the dimensions and ``tokens``.  A cell's probability is the
    yield times one factor for each dimension's value, at most 1.  A round fits
    the dimensions one after the other, cut cells included, so that what scarce
    cells cannot give comes from others of the same value.  Cells carry their
    goals and the product of their factors: a fit sums the cells by value and
    takes the correction back to them, and the cells are reread after each, so
    plans stay flat and hold one exchange and one join.  ``reached`` are the
    shares of the expected sample, to be held against the goals.  Values with
    target 0 get probability 0, those without tokens have no goal.
    """
    dims = list(targets)
    with temporary(cells.sparkSession) as write:
        goals = {d: write(_marginal(cells, d, t), f"mix-goal-{d}") for d, t in targets.items()}
        part = _yield(goals, targets, least_yield)
        goals = {d: materialize(_available(g, part), f"mix-goal-{d}") for d, g in goals.items()}
        total = cells.agg(F.sum("tokens")).first()[0] or 0
        fitted = cells
        for d in dims:
            fitted = fitted.join(goals[d].select(d, F.col("goal").alias(f"__goal_{d}")), d, "left")
        listed = reduce(lambda a, b: a & b, [F.col(f"__goal_{d}").isNotNull() for d in dims], F.lit(True))
        fitted = fitted.withColumn("__factor", F.when(listed, 1.0).otherwise(0.0))
        probability = F.least(F.lit(1.0), F.lit(part) * F.col("__factor"))
        for _ in range(rounds):
            for d in dims:
                fitted = write(fitted, f"mix-fit-{d}")
                mass = F.sum(F.col("tokens") * probability)
                grown = F.when(mass > 0, F.first(f"__goal_{d}") * F.lit(part * total) / mass).otherwise(0.0)  # one goal for each value
                fitted = fitted.join(fitted.groupBy(d).agg(grown.alias("__grown")), d, "left")
                fitted = fitted.withColumn("__factor", F.col("__factor") * F.coalesce("__grown", F.lit(0.0))).drop("__grown")
        out = materialize(fitted.select(*dims, "tokens", probability.alias("probability")), "mix-cells")
    whole = out.agg(F.sum(F.col("tokens") * F.col("probability")).alias("whole"))
    report = {}
    for d in dims:
        mass = out.groupBy(d).agg(F.sum(F.col("tokens") * F.col("probability")).alias("mass"))
        report[d] = goals[d].join(mass, d).join(F.broadcast(whole)).select(d, "goal", "share", (F.col("mass") / F.col("whole")).alias("reached"))
    return out, report


def _chances(rows: DataFrame, targets: dict[str, Target], rounds: int, least_yield: float) -> DataFrame:
    """(dimensions..., probability) of each cell of ``rows``."""
    names = list(targets)
    cells = materialize(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "mix-counts")
    raked, _ = rake(cells, targets, rounds, least_yield)
    unwanted = [F.col(d).isin([k for k, v in t.items() if not v]) for d, t in targets.items() if isinstance(t, dict)]
    untouched = (F.col("tokens") == 0) & (F.col("probability") == 0) & ~reduce(lambda a, b: a | b, unwanted, F.lit(False))
    return materialize(raked.select(*names, F.when(untouched, 1.0).otherwise(F.col("probability")).alias("probability")), "mix-chances")


def _values(dims: dict[str, Column], names: list[str]) -> list[Column]:
    return [F.coalesce(dims[d].cast("string"), F.lit(NONE)).alias(d) for d in names]


def mix(
    docs: DataFrame,
    targets: dict[str, Target],
    dims: dict[str, Column],
    rounds: int = ROUNDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_yield: float = LEAST_YIELD,
) -> DataFrame:
    """(doc_id, tokens, dimensions..., probability, sampled), one row for each input row.

    Token weights of the cells (source x language x topic) are raked to the
    marginals, see ``rake``; a document's probability is its cell's.  The
    expected sample is as large as the listed weights allow.  The draw depends
    on seed and id alone, hence not on partitions or retries.

    Null dimension values form a value of their own; null or empty texts have no
    tokens and take their cell's probability (1 where the cell and its value, or
    all rows, have none); values that no target lists stay in the sample, see
    ``_marginal``; equal ids get equal draws, a null id that of an empty string;
    repeated rows are drawn alike; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    names = list(targets)
    rows = docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("tokens"), *_values(dims, names))
    rows = materialize(rows, "mix-rows")
    chances = _chances(rows, targets, rounds, least_yield)
    return rows.join(chances, names, "left").select(
        "doc_id", "tokens", *names, "probability", (uniform_draw(F.col("doc_id"), seed) < F.col("probability")).alias("sampled")
    )


def sample(
    docs: DataFrame,
    targets: dict[str, Target],
    dims: dict[str, Column],
    rounds: int = ROUNDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_yield: float = LEAST_YIELD,
) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, with all their columns: drawn where they are read, no text is shuffled."""
    names = list(targets)
    chances = _chances(docs.select(n_words(F.col(text_col)).alias("tokens"), *_values(dims, names)), targets, rounds, least_yield)
    marked = docs.select(F.struct("*").alias("__row"), uniform_draw(F.col(id_col), seed).alias("__draw"), *_values(dims, names))
    return marked.join(chances, names, "left").filter("__draw < probability").select("__row.*")


#: Production mixture: tempered sources, listed languages and topics.
TARGETS: dict[str, Target] = {
    "source": 0.7,
    "lang": {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13},
    "topic": {"prose": 0.9, "figures": 0.04},
}


def production_dims() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}


def mix_sql(targets: dict[str, Target] = TARGETS, rounds: int = ROUNDS, seed: str = SEED, table: str = "documents") -> str:
    """DuckDB SQL of ``mix`` for dimensions source, lang and topic."""
    dims = list(targets)
    w = r"[^\x20\x09-\x0D]+"
    parts = [
        rf"""d0 AS (SELECT doc_id, coalesce(source, chr(1) || 'none') AS source, coalesce(lang, chr(1) || 'none') AS lang, coalesce(text, '') AS text,
        len(regexp_extract_all(coalesce(text, ''), '{w}')) AS tokens FROM {table}),
d AS (SELECT doc_id, source, lang, tokens, CASE WHEN len(regexp_extract_all(text, '[#*$%&|<>]')) * 20 >= tokens THEN 'symbols'
        WHEN len(regexp_extract_all(text, '[0-9]+')) * 50 >= tokens THEN 'figures' ELSE 'prose' END AS topic FROM d0),
c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)"""
    ]
    for dim, target in targets.items():
        if isinstance(target, dict):
            listed = "CASE " + dim + "".join(f" WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in target.items()) + " END"
            left = max(0.0, 1.0 - sum(target.values()))
            raw = f"coalesce(w, {left!r}::DOUBLE * t / (sum(CASE WHEN w IS NULL THEN t END) OVER ()))"
        else:
            listed, raw = "NULL", f"pow(t, {float(target)!r}::DOUBLE)"
        parts.append(
            f"g_{dim} AS MATERIALIZED (SELECT * FROM (SELECT {dim}, goal / sum(goal) OVER () AS goal, t / sum(t) OVER () AS share FROM (SELECT {dim}, t, {raw} AS goal FROM "
            f"(SELECT {dim}, t, {listed} AS w FROM (SELECT {dim}, sum(tokens) AS t FROM c GROUP BY 1) WHERE t > 0))) WHERE goal > 0)"
        )
    ratios = " UNION ALL ".join(f"SELECT min(share / goal) AS r FROM g_{d}" for d, t in targets.items() if isinstance(t, dict))
    parts.append(f"y AS MATERIALIZED (SELECT greatest({LEAST_YIELD!r}::DOUBLE, least(1.0, {MARGIN!r}::DOUBLE * min(r))) AS y, (SELECT sum(tokens) FROM c) AS total FROM ({ratios}))")
    now = {}
    for dim in dims:
        for k in range(CUTS):
            before = f"g_{dim}{k}" if k else f"g_{dim}"
            parts.append(
                f"g_{dim}{k + 1} AS MATERIALIZED (SELECT {dim}, CASE WHEN count(*) FILTER (goal > share / y) OVER () = 0 THEN goal WHEN goal >= share / y THEN share / y "
                f"ELSE goal * (1 - coalesce(sum(CASE WHEN goal >= share / y THEN share / y END) OVER (), 0)) / sum(CASE WHEN goal < share / y THEN goal END) OVER () END AS goal, share FROM {before}, y)"
            )
        now[dim] = f"(SELECT {dim}, 1.0::DOUBLE AS f FROM g_{dim}{CUTS})"
    chance = "least(1.0, y * " + " * ".join(f"coalesce(x_{d}.f, 0)" for d in dims) + ")"

    def joins() -> str:
        return "CROSS JOIN y " + " ".join(f"LEFT JOIN {now[d]} x_{d} ON c.{d} = x_{d}.{d}" for d in dims)

    for k in range(rounds):
        for dim in dims:
            parts.append(
                f"f_{dim}{k} AS MATERIALIZED (SELECT g.{dim}, CASE WHEN m > 0 THEN o.f * goal * (y * total) / m ELSE 0 END AS f FROM g_{dim}{CUTS} g JOIN {now[dim]} o ON o.{dim} = g.{dim} "
                f"JOIN (SELECT c.{dim}, sum(tokens * {chance}) AS m FROM c {joins()} GROUP BY 1) s ON g.{dim} = s.{dim} CROSS JOIN y)"
            )
            now[dim] = f"f_{dim}{k}"
    parts.append(f"p AS (SELECT c.source, c.lang, c.topic, {chance} AS p FROM c {joins()})")
    draw = f"('0x' || substr(sha256('{seed}:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, tokens, source, lang, topic, round(p, 6) AS probability, {draw} < p AS sampled "
        "FROM d JOIN p USING (source, lang, topic)"
    )
