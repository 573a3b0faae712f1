"""Document rates that bring expected domain totals to target weights (operator 1). Columns and aggregations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm._common import pick, stored

DOMAINS = ("good", "poor", "toxic")
#: Default target shares of the expected tokens.
TARGETS = {"good": 0.9, "poor": 0.06, "toxic": 0.04}
#: Scales of the log-odds among which held-out labels choose.
TEMPERS = (0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0)


def domain_of_label() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """White-space separated words of the text in lower case; null and blank texts have none."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\f\r", "     ")
    return F.array_remove(F.split(t, " "), "")


def features(text: Column) -> Column:
    """The number of words (n), and (f) the distinct words with one mark for how much they repeat given how many there are."""

    def of(x: Column) -> Column:
        ratio = F.floor(F.size(x["d"]) * 8 / F.greatest(x["n"], F.lit(1))).cast("string")
        size = F.floor(F.log2(x["n"] + F.lit(1.0)) / 2).cast("string")
        return F.struct(x["n"].cast("long").alias("n"), F.concat(x["d"], F.array(F.concat_ws(" ", F.lit("repeats"), ratio, size))).alias("f"))

    return let(let(tokens(text), lambda w: F.struct(F.size(w).alias("n"), F.array_distinct(w).alias("d"))), of)


def fit_domains(docs: DataFrame, labels: DataFrame, max_labelled: int, vocabulary: int) -> dict | None:
    """Naive Bayes over the presence of the words that tell domains apart best.

    Fitted on at most ``max_labelled`` labelled documents (chosen by a hash of the id) and at most ``vocabulary`` words
    by chi-square; only those words' counts reach the driver. Returns prior and, per word, the log-odds by domain.
    """
    lab = (
        pick(labels, doc_id="doc_id", quality="quality", toxic="toxic")
        .filter("doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("id"), domain_of_label().alias("domain"))
        .filter("domain is not null")
        .groupBy("id")
        .agg(F.min("domain").alias("domain"))
    )
    n = lab.count()
    if not n:
        return None
    if n > max_labelled:  # by rank of the hash, among those of a low one: the same rows whatever the partitioning
        place, near = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 40)), min(1.0, (max_labelled + 5 * math.sqrt(max_labelled) + 50) / n)
        lab = lab.withColumn("place", place).filter(F.col("place") < int(near * (1 << 40))).orderBy("place", "id").limit(max_labelled).drop("place")
    sample = stored(docs.select("id", "text").join(F.broadcast(lab), "id").select("id", "domain", features(F.col("text"))["f"].alias("f")), "labelled")
    held = F.pmod(F.xxhash64("id", F.lit(31)), F.lit(4)) == 0
    known = sample.filter(~held)
    size = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    total = sum(size.values())
    if not total:
        return None
    counts = [F.sum((F.col("domain") == d).cast("long")).alias(d) for d in DOMAINS]
    each = known.select("domain", F.explode("f").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *counts).filter(F.col("n") >= 5)
    gain = sum(
        F.when(F.lit(size.get(d, 0) > 0), F.pow(F.col(d) - F.col("n") * (size.get(d, 0) / total), 2) / (F.col("n") * max(size.get(d, 0), 1) / total)).otherwise(0.0)
        for d in DOMAINS
    ) * (F.lit(float(total)) / (F.lit(total + 1.0) - F.col("n")))
    top = each.orderBy(F.desc(gain), "word").limit(vocabulary).collect()
    prior = {d: math.log((size.get(d, 0) + 1) / (total + len(DOMAINS))) for d in DOMAINS}
    weights, absent = {}, dict.fromkeys(DOMAINS, 0.0)
    for r in top:
        has = {d: (r[d] + 0.5) / (size.get(d, 0) + 1) for d in DOMAINS}
        weights[r["word"]] = [math.log(has[d] / (1 - has[d])) for d in DOMAINS]
        for d in DOMAINS:
            absent[d] += math.log(1 - has[d])
    model = {"prior": [prior[d] for d in DOMAINS], "absent": [absent[d] for d in DOMAINS], "words": weights}
    # words of one text are not independent: the log-odds are scaled as held-out labels fit best
    told = [F.avg(F.log(F.greatest(_right(posterior(F.col("f"), model | {"temper": x})), F.lit(1e-9)))).alias(f"l{i}") for i, x in enumerate(TEMPERS)]
    fits = sample.filter(held).agg(*told).first()
    best = max(range(len(TEMPERS)), key=lambda i: fits[i] if fits[i] is not None else -math.inf)
    return model | {"temper": TEMPERS[best]}


def _right(p: Column) -> Column:
    """The posterior of the row's own domain."""
    return F.element_at(p, F.array_position(F.array(*[F.lit(d) for d in DOMAINS]), F.col("domain")).cast("int"))


def posterior(f: Column, model: dict | None) -> Column:
    """Domain posteriors of the features, as an array in the order of DOMAINS; without a model all are alike."""
    k = len(DOMAINS)
    if model is None:
        return F.array(*[F.lit(1.0 / k)] * k)
    words = sorted(model["words"])
    table = F.create_map(*[c for w in words for c in (F.lit(w), F.array(*[F.lit(float(x)) for x in model["words"][w]]))]) if words else None
    start = F.array(*[F.lit(float(x)) for x in model["absent"]])
    prior = F.array(*[F.lit(float(x)) for x in model["prior"]])
    if table is None:
        logits = start
    else:
        seen = F.array_intersect(f, F.array(*[F.lit(w) for w in words]))
        logits = F.aggregate(seen, start, lambda a, w: F.zip_with(a, F.try_element_at(table, w), lambda x, y: x + y))
    high = F.zip_with(prior, logits, lambda a, x: a + x * model["temper"])
    mass = let(high, lambda h: F.transform(h, lambda x: F.exp(x - F.array_max(h))))
    return let(mass, lambda h: F.transform(h, lambda x: x / F.aggregate(h, F.lit(0.0), lambda a, y: a + y)))


def inverse(m: list[list[float]]) -> list[list[float]]:
    """The inverse of a small positive definite matrix."""
    n = len(m)
    rows = [[*r, *(float(i == j) for j in range(n))] for i, r in enumerate(m)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[p] = rows[p], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [r[n:] for r in rows]


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    budget: float | None = None,
    tolerance: float = 1e-6,
    steps: list | None = None,
    max_labelled: int = 4000,
    vocabulary: int = 128,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, p_good, p_poor, p_toxic, rate.

    ``rate`` is how many copies of the document to draw in expectation. Rates are nonnegative and minimise the squared
    distance between the expected tokens of each domain, sum(rate * n_tokens * p_domain), and ``budget`` (default: all
    tokens) times the target share. Domains come from the label table; texts belong to them softly. Distance is taken
    in the metric of the inverse second moments of the posteriors, in which overlapping domains don't slow the descent;
    targets that can be met are met in any metric.

    The rates are found by projected gradient steps in their lazy form: scaled gradients add up to one number a domain
    (``pull``), and the rates are the even rate minus p . pull, cut at zero. A step is one aggregation over the narrow
    table of tokens and posteriors: of each of three step lengths it gives the domain totals and the second moments of the
    documents whose rate is not cut, which scale the next gradient. Of all rates that meet the targets these differ least
    from the even one. A price on that difference, which falls by ten whenever the steps have settled, keeps ``pull``
    finite. There is no bound on steps: they end when the distance is at most ``tolerance`` of the budget, or when the
    price has fallen below 1e-7 and a further tenth lessens the distance by less than a thousandth, which is the nearest
    point to targets out of reach. ``steps`` receives the distances. The texts are read once, and the narrow table is
    written to the shared folder.

    Nulls and edge cases: null and empty texts have no tokens and add nothing; repeated rows each get a rate; ids may be
    null; without usable labels all posteriors are alike; a target that no document can serve is approached as far as
    the others allow; no rows give no rows. Extra columns are ignored.
    """
    targets = TARGETS if targets is None else targets
    src = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    model = fit_domains(src, labels, max_labelled, vocabulary)
    k = range(len(DOMAINS))
    one = let(
        features(F.col("text")),
        lambda x: let(posterior(x["f"], model), lambda p: F.struct(x["n"].alias("n"), *[p[i].alias(f"p{i}") for i in k])),
    )
    flat = stored(src.select("id", F.explode(F.array(one)).alias("x")).select("id", "x.*"), "posteriors")
    second = [F.sum(F.col("n") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}{j}") for i in k for j in k]
    m = flat.agg(F.sum("n").alias("n"), *second).first()
    total = m["n"] or 0
    names = [F.col(f"p{i}").alias(f"p_{d}") for i, d in zip(k, DOMAINS, strict=True)]
    if not total:
        return flat.select(F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), *names, F.lit(1.0).alias("rate"))
    want = [targets.get(d, 0.0) * (budget or total) / total for d in DOMAINS]
    size, trace = sum(want), sum(m[f"m{i}{i}"] for i in k) / total
    soft = [[m[f"m{i}{j}"] / total + (1e-6 * trace if i == j else 0.0) for j in k] for i in k]
    metric = inverse(soft)

    def dot(a, b) -> float:
        return sum(x * y for x, y in zip(a, b, strict=True))

    def times(matrix: list[list[float]], v: list[float]) -> list[float]:
        return [dot(row, v) for row in matrix]

    def rate(pull: list[float]) -> Column:
        return F.greatest(F.lit(0.0), F.lit(size) - sum((F.col(f"p{i}") * pull[i] for i in k), F.lit(0.0)))

    def tried(pulls: list[list[float]]) -> list[tuple]:
        """Of every pull: its gap to the targets by domain, the moments of what it doesn't cut, and the mean squared rate."""
        sums, each = [], flat
        for c, pull in enumerate(pulls):
            each = each.withColumn(f"rate{c}", rate(pull))
            r, live = F.col(f"rate{c}"), F.when(F.col(f"rate{c}") > 0, F.col("n")).otherwise(0)
            sums += [F.sum(F.col("n") * F.col(f"p{i}") * r).alias(f"t{c}{i}") for i in k]
            sums += [F.sum(live * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"a{c}{i}{j}") for i in k for j in k if i <= j]
            sums.append(F.sum(F.col("n") * r * r).alias(f"q{c}"))
        got = each.agg(*sums).first()
        return [([got[f"t{c}{i}"] / total - want[i] for i in k], [[got[f"a{c}{min(i, j)}{max(i, j)}"] / total for j in k] for i in k], got[f"q{c}"] / total) for c in range(len(pulls))]

    def cost(pull: list[float], square: float) -> float:
        return square / 2 + dot(pull, want) + price / 2 * dot(pull, times(soft, pull))

    pull, price, settled = [0.0] * len(DOMAINS), 1e-3, None
    gap, moments, square = tried([pull])[0]
    while True:
        miss = math.sqrt(max(0.0, dot(gap, times(metric, gap))))
        if steps is not None:
            steps.append(miss / size if size else miss)
        if miss <= tolerance * size:
            break
        while True:
            slope = [x - price * y for x, y in zip(gap, times(soft, pull), strict=True)]
            if math.sqrt(max(0.0, dot(slope, times(metric, slope)))) > max(miss / 100, tolerance * size / 10):
                step = times(inverse([[moments[i][j] + price * soft[i][j] for j in k] for i in k]), slope)
                pulls = [[x + c * y for x, y in zip(pull, step, strict=True)] for c in (1.0, 0.3, 0.05)]
                found = tried(pulls)
                best = min(range(len(pulls)), key=lambda c: cost(pulls[c], found[c][2]))
                if cost(pulls[best], found[best][2]) < cost(pull, square):
                    pull, (gap, moments, square) = pulls[best], found[best]
                    break
            # the steps have settled at this price
            if settled is not None and settled - miss <= 1e-3 * miss and price < 1e-7:
                found = None
                break
            settled, price = miss, price / 10
        if found is None:
            break
    rounded = [F.round(F.col(f"p{i}"), 6).alias(f"p_{d}") for i, d in zip(k, DOMAINS, strict=True)]
    return flat.select(F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), *rounded, F.round(rate(pull), 6).alias("rate"))
