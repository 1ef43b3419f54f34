"""Quality rules: robust multivariate outliers per language and source, in DataFrame functions only.

Statistics of each text are transformed; a minimum-covariance-determinant estimate of each group is
found by concentration steps from three starts, of which the one of the least determinant goes on until nothing
changes: distances by a Cholesky factor written out in column expressions, sums by group and bin of distance, the
bins of the nearest share of a group, their mean and covariance. Estimates of a language and source lean on their
language's, these on all. A document is rejected for its Mahalanobis distance from its group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.llm.runtime import remove, table, written

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: The weight, in documents, that the estimate of a language has in each of its sources', and that of all in a language's.
PRIOR = 50
#: The share of a group that the estimate is of, and the chance of rejecting a regular document.
SHARE, REJECT = 0.75, 1e-7
#: Steps from each start, and steps at most; and what the logarithm of a determinant moves on average once steps have settled.
FIRST_STEPS, MOST_STEPS, SETTLED = 2, 10, 1e-2
#: More estimates than this are joined by a shuffle, not sent to every task.
MOST_SENT = 20_000
#: Spreads that statistics are granted at least: most texts have no symbol and no repeat at all.
FLOOR = {"x_words": 0.5, "x_length": 0.08, "x_symbols": 0.25, "x_shouts": 0.25, "x_lines": 0.8, "x_repeats": 0.8}
STATS = list(FLOOR)
WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value taken once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def without(text: Column, chars: str) -> Column:
    """The number of characters of text that aren't among chars."""
    return F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that the text has twice or more, by 64-bit hashes of windows."""

    def covered(windows: Column) -> Column:
        # Pairs of hash and place in order: a hash that its neighbour has too is repeated. No comparator, so no lambda for each comparison.
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        last = F.size(windows) - 1

        def twice(a: Column) -> Column:
            same = F.zip_with(F.slice(a, 1, last), F.slice(a, 2, last), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull()))))

        start = F.struct(F.lit(-WINDOW).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda s, p: F.struct(p.alias("end"), (s["n"] + F.least(F.lit(WINDOW), p - s["end"])).alias("n"))
        return let(placed, lambda a: F.aggregate(twice(a), start, step, lambda s: s["n"]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])))
    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(found)


def statistics(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, language, group, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) and the transformed STATS."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated")))
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, WHITE) > 0)
    base = docs.select(
        F.col("doc_id"), F.to_json(F.struct("lang")).alias("language"), F.to_json(F.struct("lang", "source")).alias("group"), by_words.alias("w"), without(text, WHITE).cast("long").alias("word_chars"),
        (F.length(text) - without(text, "#*$%&|<>")).cast("long").alias("n_symbols"), let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        (F.length(text) - without(text, "!ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("shouts"),
    )
    base = base.select("*", F.col("w.n").alias("n_words"), F.col("w.repeated").alias("n_repeat_words")).drop("w")
    n = F.greatest("n_words", F.lit(1))
    # Twenty words of five characters are added to the mean length, which a few words would leave to chance.
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scaled = {
        "x_words": F.log1p("n_words"), "x_length": F.log((F.col("word_chars") + 100) / (n + 20)), "x_symbols": F.log1p(10 * F.col("n_symbols") / n),
        "x_shouts": F.log1p(10 * F.col("shouts") / n), "x_lines": F.log1p(100 * F.col("n_dup_lines") / n), "x_repeats": F.log1p(100 * F.col("n_repeat_words") / n),
    }
    return base.select("doc_id", "language", "group", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *[v.cast("double").alias(k) for k, v in scaled.items()])


def chi_square(x: float, d: int) -> float:
    """The distribution function for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(d // 2))


def chi_square_point(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, d) < p else (low, mid)
    return low


def distance() -> tuple[str, dict[str, str]]:
    """The squared Mahalanobis distance of a row's STATS from its centre m_* under the factor l_*_*, and the columns it is summed from: forward substitution."""
    solved = {}
    for i, s in enumerate(STATS):
        less = "".join(f" - l_{i}_{j} * y_{j}" for j in range(i))
        solved[f"y_{i}"] = f"({s} - m_{i}{less}) / l_{i}_{i}"
    return " + ".join(f"{y} * {y}" for y in solved), solved


def with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows with d2, and start where params have several for a key. Hot keys stay where they are while the estimates are few."""
    params = F.broadcast(params) if params.count() <= MOST_SENT else params
    total, solved = distance()
    names = [*rows.columns, *(["start"] if "start" in params.columns else [])]
    rows = rows.join(params, "key")
    for name, v in solved.items():
        rows = rows.withColumn(name, F.expr(v))
    return rows.select(*names, F.expr(total).alias("d2"))


PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def sums() -> list[Column]:
    """Aggregates of STATS: their number, sums, and sums of products."""
    return [F.expr(x) for x in ("cast(count(*) as double) as n", *(f"sum({s}) as s_{i}" for i, s in enumerate(STATS)), *(f"sum({STATS[i]} * {STATS[j]}) as q_{i}_{j}" for i, j in PAIRS))]


SUMS = ["n", *[f"s_{i}" for i in range(len(STATS))], *[f"q_{i}_{j}" for i, j in PAIRS]]


def factored(params: DataFrame) -> DataFrame:
    """Cholesky factors l_i_j of the covariances c_i_j (i >= j), column by column, and the logarithm of the determinant."""
    d = len(STATS)
    for j in range(d):
        rest = f"c_{j}_{j}" + "".join(f" - l_{j}_{k} * l_{j}_{k}" for k in range(j))
        params = params.withColumn(f"l_{j}_{j}", F.expr(f"sqrt(greatest({rest}, {FLOOR[STATS[j]] ** 2 * 1e-3}D))"))
        new = {f"l_{i}_{j}": F.expr(f"(c_{i}_{j}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j)) + f") / l_{j}_{j}") for i in range(j + 1, d)}
        params = params.withColumns(new) if new else params
    return params.withColumn("logdet", F.expr(" + ".join(f"2 * ln(l_{i}_{i})" for i in range(d))))


def centred(moments: DataFrame, parents: DataFrame, consistent: float) -> DataFrame:
    """Estimates (key, start, m_*, l_*_*, logdet) from sums (key, start, n, s_*, q_*_*): means, and covariances times `consistent`, which lean on the parent's.

    parents: key, level, parent. A group of n rows counts as n, its parent as PRIOR rows around the parent's
    centre; so a small group has nearly its parent's estimate, a large one its own, without a jump. FLOOR squared is added
    on the diagonal.
    """
    d = range(len(STATS))
    names = ["key", "start", *[f"m_{i}" for i in d], *[f"c_{i}_{j}" for i, j in PAIRS]]
    own = moments.join(parents, "key").selectExpr("key", "start", "level", "parent", "n", *[f"s_{i} / n as m_{i}" for i in d], *[f"{consistent!r}D * (q_{i}_{j} / n - s_{i} / n * s_{j} / n) as c_{i}_{j}" for i, j in PAIRS])
    level = own.where("level = 0").select(*names)
    out = level
    for k in (1, 2):
        above = level.selectExpr("key as parent", "start", *[f"{c} as p_{c}" for c in names[2:]])
        level = own.where(f"level = {k}").join(above, ["parent", "start"]).selectExpr(
            "key", "start", *[f"(n * m_{i} + {PRIOR} * p_m_{i}) / (n + {PRIOR}) as m_{i}" for i in d],
            *[f"(n * c_{i}_{j} + {PRIOR} * p_c_{i}_{j} + n * {PRIOR} / (n + {PRIOR}) * (m_{i} - p_m_{i}) * (m_{j} - p_m_{j})) / (n + {PRIOR}) as c_{i}_{j}" for i, j in PAIRS],
        )
        out = out.unionByName(level)
    floor = {f"c_{i}_{i}": F.expr(f"c_{i}_{i} + {FLOOR[s] ** 2}D") for i, s in enumerate(STATS)}
    return factored(out.withColumns(floor)).drop(*[f"c_{i}_{j}" for i, j in PAIRS])


def concentrated(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Sums (key, start, n, s_*, q_*_*) over the nearest SHARE of each key's rows.

    Sums are taken by bins of distance of 2 %, up to a large one, so that a key of any size moves as at most
    2,001 rows that are dealt by key and bin; only these are put in order for the share. The last bin counts whole.
    """
    bin_ = F.least(F.floor(50 * F.log1p("d2")), F.lit(2000)).cast("int")
    by_bin = with_distance(rows, params).withColumn("bin", bin_).groupBy("key", "start", "bin").agg(*sums())
    whole = Window.partitionBy("key", "start")
    before = F.coalesce(F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    near = by_bin.withColumn("enough", before >= SHARE * F.sum("n").over(whole)).where("not enough")
    return near.groupBy("key", "start").agg(*[F.sum(c).alias(c) for c in SUMS])


def estimates(rows: DataFrame) -> DataFrame:
    """Per key the centre m_* and factor l_*_* of the minimum-covariance-determinant estimate of STATS.

    rows: keys (an array of three: all, the language, the language and source) and STATS. Starts are quartiles, the rows
    within reach of the quartiles, and all rows; after FIRST_STEPS steps each key keeps the start of the least
    determinant, and steps go on until determinants have SETTLED, MOST_STEPS at most. Covariances get the factor that makes
    the covariance of the nearest SHARE right for a normal distribution.
    """
    spark, d = rows.sparkSession, len(STATS)
    point = chi_square_point(SHARE, d)
    consistent = SHARE / chi_square(point, d + 2)
    keys = F.col("keys")
    parents, _ = written(rows.select(F.explode(F.array(*[F.struct(keys[k].alias("key"), F.lit(k).alias("level"), keys[max(0, k - 1)].alias("parent")) for k in range(3)])).alias("x")).select("x.*").distinct(), "groups")
    long = rows.select(F.explode("keys").alias("key"), *STATS)
    # Sketches of quartiles are small: they are merged in one place for each key.
    quart, _ = written(long.groupBy("key").agg(*[F.percentile_approx(s, [0.25, 0.5, 0.75], 200).alias(f"x_{i}") for i, s in enumerate(STATS)]), "quartiles")
    spread = {i: F.pow((F.col(f"x_{i}")[2] - F.col(f"x_{i}")[0]) / 1.349, 2) + FLOOR[s] ** 2 for i, s in enumerate(STATS)}
    quick = quart.select("key", F.lit(0).alias("start"), *[F.col(f"x_{i}")[1].alias(f"m_{i}") for i in range(d)], *[(spread[i] if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS])
    centre = F.broadcast(quart) if quart.count() <= MOST_SENT else quart
    reach = [F.abs(F.col(s) - F.col(f"x_{i}")[1]) <= 2.5 * F.sqrt(spread[i]) for i, s in enumerate(STATS)]
    inside = reach[0]
    for r in reach[1:]:
        inside = inside & r
    kinds = F.explode(F.when(inside, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))).alias("start")
    # Dealt by a few numbers besides the key, then summed: a hot key has no task of its own.
    met = long.join(centre, "key").select("key", kinds, F.pmod(F.xxhash64(*STATS), F.lit(64)).alias("deal"), *STATS)
    first = met.groupBy("key", "start", "deal").agg(*sums()).groupBy("key", "start").agg(*[F.sum(c).alias(c) for c in SUMS])
    more = centred(written(first, "sums")[0], parents, 1.0)
    params, path = written(factored(quick).drop(*[f"c_{i}_{j}" for i, j in PAIRS]).unionByName(more), "centres")
    total = 0.0
    for step in range(MOST_STEPS):
        moments, taken = written(concentrated(long, params), "sums")
        after = centred(moments, parents, consistent)
        if step == FIRST_STEPS - 1:  # the start of the least determinant goes on, under one number
            best = Window.partitionBy("key").orderBy("logdet", "start")
            after = after.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place").withColumn("start", F.lit(0))
        after, new = written(after, "centres")
        for old in (path, taken):
            remove(spark, old)
        params, path = after, new
        now, n = params.agg(F.coalesce(F.sum("logdet"), F.lit(0.0)), F.count("*")).head()
        if not n or step >= FIRST_STEPS and abs(now - total) < SETTLED * n:
            break
        total = now
    return params.drop("start", "logdet")


def judged(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) for all docs.

    docs: doc_id, text, lang, source. A null text has no words and fails the base rules; a null language or
    source is a group of its own. Documents that fail the base rules take no part in estimates and
    have no distance. The fewer documents a group has, the more it leans on its language, and that on all.
    Repeated rows count and stay; an empty table gives none, and where all documents fail there is nothing to estimate.
    """
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    stats, _ = written(statistics(docs), "statistics")
    rows = stats.where("not base_failed").withColumn("keys", F.array(F.lit("all"), "language", "group"))
    params, _ = written(estimates(rows.select("keys", *STATS)), "estimates")
    limit = chi_square_point(1 - REJECT, len(STATS))
    far = with_distance(rows.select(*base, *STATS, F.col("group").alias("key")), params)
    good = far.select(*base, F.lit(False).alias("base_failed"), (F.col("d2") <= limit).alias("kept"), F.col("d2").alias("distance"))
    bad = stats.where("base_failed").select(*base, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return good.unionByName(bad)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: base rules and robust outliers over all documents."""
    return judged(table(spark, sf_dir, "documents"))
