"""Personal data by weak supervision (operator 8). Columns and aggregations only; models are fitted on counts of patterns."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm._common import pick, stored

KINDS = ["email", "ip", "card", "phone"]
#: What defines the base spans. Possessive repeats and the look-behinds find the same matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser shapes of the same kinds, and secrets, which have no base pattern; their matches are only candidates.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|[\[({]\x20?(?i:dot)\x20?[\])}])\x20?[A-Za-z0-9-]{1,64}){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,512}+(?![A-Za-z0-9_+/-])",
}
ALL_KINDS = [*KINDS, "secret"]
#: A text without a match of these has no span of the kind; they are cheap to look for. A card has 16 digits at least,
#: which may stand singly; only the looser shape has groups.
GATE = {
    "email": "@|[aA][tT]\x20?[\\])}]",
    "ip": r"[0-9][\])]?[.\[(]",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15}|[0-9]{4}[./_][0-9]{4}[./_]",
    "phone": r"\+[0-9]|[0-9][.\x20-][0-9]{4}",
    "secret": r"[A-Za-z0-9_+/-]{20}",
}
# Words that speak for a kind when they stand before or after a candidate, words that speak against any,
# and the gazetteers: top-level domains, issuer ranges (first four digits), country codes and key prefixes.
FOR = {
    "email": ["email", "e-mail", "mail", "contact", "write", "reach", "adresse", "correo", "courriel"],
    "ip": ["ip", "address", "host", "server", "login", "client", "addr", "gateway"],
    "card": ["card", "visa", "mastercard", "amex", "credit", "debit", "payment", "tarjeta", "karte", "carte", "expires", "cvv"],
    "phone": ["phone", "tel", "call", "fax", "mobile", "cell", "telefon", "sms", "ext"],
    "secret": ["token", "secret", "key", "apikey", "password", "passwd", "pwd", "bearer", "auth", "credential"],
}
AGAINST = ["version", "release", "isbn", "issn", "order", "invoice", "section", "chapter", "page", "total", "serial", "doi", "checksum", "commit", "sha"]
GAZETTEERS = {
    "email": ["com", "org", "net", "edu", "gov", "mil", "int", "io", "co", "info", "biz", "app", "dev", "de", "fr", "es", "it", "nl", "uk", "eu", "ch", "at", "pl", "se", "no", "dk", "fi", "pt", "ru", "cn", "jp", "kr", "in", "br", "mx", "ar", "ca", "au", "nz", "us"],
    "card": [(4000, 4999), (5100, 5599), (2221, 2720), (3400, 3499), (3700, 3799), (3528, 3589), (3000, 3059), (3600, 3699), (3800, 3999), (6011, 6011), (6440, 6599), (6200, 6299), (5000, 5099), (5600, 5899), (6300, 6399), (6700, 6799)],
    "phone": ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"],
    "secret": ["AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "rk_live_", "hf_", "npm_"],
}
LABELERS = 5  # pattern, gazetteer, words before, words after, marks around
#: What the classifier sees: the votes, length, share of digits, separators, kind of character before and after, hashed words.
PLACES = [*[3] * LABELERS, 8, 5, 5, 5, 5, 32, 32]
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))
    n = F.length(d)

    def step(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return F.floor(v / 10).cast("int") + v % 10

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), step), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern is a span of the kind."""
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(value)).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, both, start: int) -> Column:
    """Running totals of an array of numbers under ``both`` (sum, maximum, ...). Appending copies what is there, so totals
    are gathered in blocks of 128, and the blocks in a second array."""

    def of(v: Column) -> Column:
        def block(k: Column, before: Column) -> Column:
            places = F.sequence(k * 128 + 1, F.least((k + 1) * 128, F.size(v)))
            empty = F.struct(before.alias("total"), F.array().cast("array<int>").alias("out"))

            def add(acc: Column, i: Column) -> Column:
                return let(both(acc["total"], F.element_at(v, i)), lambda t: F.struct(t.alias("total"), F.concat(acc["out"], F.array(t)).alias("out")))

            return F.aggregate(places, empty, add)

        def more(acc: Column, k: Column) -> Column:
            return let(block(k, acc["total"]), lambda x: F.struct(x["total"].alias("total"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        empty = F.struct(F.lit(start).alias("total"), F.array().cast("array<array<int>>").alias("out"))
        blocks = F.sequence(F.lit(0), ((F.size(v) - 1) / 128).cast("int"))
        return F.flatten(F.aggregate(blocks, empty, more, lambda acc: acc["out"]))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, pattern: str, gate: Column, kept=None) -> Column:
    """All matches (those that are ``kept``) with their places and 40 characters on either side: what splitting leaves
    between the matches gives the distances, whose running sum are the places."""
    none = F.array().cast(f"array<{_SPAN}>")

    def placed(x: Column) -> Column:
        found, between = x["found"], x["between"]
        ends = scan(F.transform(found, lambda v, i: F.length(v) + F.length(F.try_element_at(between, i + 1))), lambda a, b: a + b, 0)
        numbers = F.sequence(F.lit(1), F.size(found))
        if kept is not None:
            numbers = F.filter(numbers, lambda i: kept(F.element_at(found, i)))

        def one(end: Column):
            def of(i: Column) -> Column:
                value, to = F.element_at(found, i), F.element_at(end, i)
                return F.struct(
                    (to - F.length(value)).alias("start"), to.alias("end"), value.alias("value"), F.right(F.element_at(between, i), F.lit(40)).alias("before"), F.left(F.element_at(between, i + 1), F.lit(40)).alias("after")
                ).cast(_SPAN)

            return of

        return let(ends, lambda end: F.transform(numbers, one(end)))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(gate, let(both, lambda x: F.when(F.size(x["found"]) > 0, placed(x)).otherwise(none))).otherwise(none)


def apart(loose: Column, base: Column) -> Column:
    """The spans of ``loose`` that touch no span of ``base``, in the order of their start."""
    far = F.lit(2**31 - 1)
    kind = "array<struct<start:int,end:int,base:boolean,value:string,before:string,after:string>>"
    mine = F.transform(loose, lambda x: F.struct(x["start"], x["end"], F.lit(False), x["value"], x["before"], x["after"])).cast(kind)
    other = F.transform(base, lambda x: F.struct(x["start"], x["end"], F.lit(True), F.lit(""), F.lit(""), F.lit(""))).cast(kind)

    def judged(a: Column) -> Column:
        reach = scan(F.transform(a, lambda x: F.when(x["base"], x["end"]).otherwise(0)), F.greatest, 0)
        after = F.reverse(scan(F.reverse(F.transform(a, lambda x: F.when(x["base"], x["start"]).otherwise(far))), F.least, 2**31 - 1))
        every = F.arrays_zip(a.alias("x"), reach.alias("reach"), after.alias("after"))
        free = F.filter(every, lambda z: ~z["x"]["base"] & (z["reach"] <= z["x"]["start"]) & (z["after"] >= z["x"]["end"]))
        return F.transform(free, lambda z: F.struct(*[z["x"][c].alias(c) for c in ("start", "end", "value", "before", "after")]))

    some = (F.size(loose) > 0) & (F.size(base) > 0)
    return F.when(some, let(F.array_sort(F.concat(mine, other)), judged)).otherwise(loose)


def _any(words: list[str]) -> str:
    return r"(?<![a-z])(?:" + "|".join(words) + r")s?(?![a-z])"


def _votes(kind: str, c: Column, base: bool, lists: dict) -> list[Column]:
    """Votes of the labelers (0 against, 1 abstains, 2 for)."""
    value, digits = c["value"], _digits(c["value"])
    n = F.length(digits)
    by_pattern = {
        "email": F.when(F.lit(base) | value.rlike(r"\.|[dD][oO][tT]"), 2).otherwise(1),
        "ip": F.when(F.regexp_replace(value, r"[\[\]()]", "").rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"), 2).otherwise(0),
        "card": F.when(_luhn(value), 2).otherwise(0),
        "phone": F.when(~n.between(8, 15), 0).when(value.rlike(r"^[+(]"), 2).otherwise(1),
        "secret": F.when(value.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (value.rlike("[A-Z]") & value.rlike("[a-z]") & (n * 8 >= F.length(value))), 2).when(n * 16 < F.length(value), 0).otherwise(1),
    }[kind]
    by_list = {
        "email": F.when(F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)).isin(lists["email"]), 2).otherwise(1),
        "ip": F.when(F.regexp_extract(value, "^0*([0-9]+)", 1).try_cast("int").between(1, 223), 2).otherwise(0),
        "card": F.when(_between(F.left(digits, F.lit(4)).try_cast("int"), lists["card"]), 2).otherwise(0),
        "phone": F.when(value.rlike(r"^\([2-9]|^[2-9]") | (value.rlike(r"^\+") & (F.substring(digits, 1, 1).isin(lists["phone"]) | F.substring(digits, 1, 2).isin(lists["phone"]))), 2).otherwise(1),
        "secret": F.when(value.rlike("^(?:" + "|".join(lists["secret"]) + ")"), 2).when(value.rlike(r"(.)\1{7}|(?i:example|placeholder)"), 0).otherwise(1),
    }[kind]

    def by_words(text: Column) -> Column:
        return F.when(text.rlike(_any(AGAINST)), 0).when(text.rlike(_any(FOR[kind])), 2).otherwise(1)

    marks = F.when(c["before"].rlike(r"[:=\"'(<#]\x20?$"), 2).when(c["before"].rlike(r"[\p{L}0-9_/.-]$") | c["after"].rlike(r"^[\p{L}0-9_/-]"), 0).otherwise(1)
    return [by_pattern, by_list, by_words(F.lower(c["before"])), by_words(F.lower(c["after"])), marks]


def _between(n: Column, ranges: list[tuple[int, int]]) -> Column:
    known = F.expr("array(" + ", ".join(f"struct({lo} as lo, {hi} as hi)" for lo, hi in ranges) + ")")
    return F.coalesce(F.exists(known, lambda r: n.between(r["lo"], r["hi"])), F.lit(False))


def _around(c: Column) -> list[Column]:
    """What the classifier sees beyond the votes, each as a number below its entry of ``PLACES``."""
    value, n = c["value"], F.length(c["value"])

    def kind(ch: Column) -> Column:
        return F.when(ch == "", 0).when(ch.rlike(r"\s"), 1).when(ch.rlike("[0-9]"), 2).when(ch.rlike(r"\p{L}"), 3).otherwise(4)

    def word(w: Column) -> Column:
        return F.when(w == "", 0).otherwise(F.pmod(F.xxhash64(F.lower(w)), F.lit(31)) + 1)

    marks = F.regexp_replace(value, "[A-Za-z0-9]", "")
    return [
        F.least(F.floor(n / 5), F.lit(7)),
        F.floor(F.length(_digits(value)) * 4 / n),
        F.when(marks == "", 0).when(marks.rlike(r"^\x20+$"), 1).when(marks.rlike("^-+$"), 2).when(marks.rlike(r"^\.+$"), 3).otherwise(4),
        kind(F.right(c["before"], F.lit(1))),
        kind(F.left(c["after"], F.lit(1))),
        word(F.regexp_extract(c["before"], r"(\p{L}+)[^\p{L}]*$", 1)),
        word(F.regexp_extract(c["after"], r"^[^\p{L}]*(\p{L}+)", 1)),
    ]


def estimate(patterns: list[tuple[str, str, int]], rounds: int = 200) -> dict[str, tuple[float, list[list[float]]]]:
    """How far each labeler can be trusted, by expectation-maximisation: per kind the log-odds of personal data without
    votes, and for each labeler and vote what that adds.

    patterns: (kind, votes as digits, count). Each kind has its own prior and each labeler its own chance of every vote in
    either class; starting point is the majority, and pseudo-counts keep the two classes from being exchanged.
    """
    out = {}
    for kind in ALL_KINDS:
        rows = [([int(x) for x in v], n) for k, v, n in patterns if k == kind]
        post = [1 / (1 + math.exp(-1.5 * sum(x - 1 for x in v))) for v, _ in rows]
        prior, weight = 0.0, [[0.0] * 3 for _ in range(LABELERS)]
        for _ in range(rounds):
            good, bad = 2 + sum(n * p for (_, n), p in zip(rows, post, strict=True)), 2 + sum(n * (1 - p) for (_, n), p in zip(rows, post, strict=True))
            prior = math.log(good / bad)
            for i, x in product(range(LABELERS), range(3)):
                g = sum(n * p for (v, n), p in zip(rows, post, strict=True) if v[i] == x)
                b = sum(n * (1 - p) for (v, n), p in zip(rows, post, strict=True) if v[i] == x)
                weight[i][x] = math.log((g + (0.2, 0.6, 1.2)[x]) / good) - math.log((b + (1.2, 0.6, 0.2)[x]) / bad)
            new = [1 / (1 + math.exp(-max(-50.0, min(50.0, prior + sum(weight[i][x] for i, x in enumerate(v)))))) for v, _ in rows]
            moved = max((abs(a - b) for a, b in zip(new, post, strict=True)), default=0)
            post = new
            if moved < 1e-9:
                break
        out[kind] = (prior, weight)
    return out


def classifier(counts: list[tuple[str, int, int, float, float]]) -> dict[str, tuple[float, list[list[float]]]]:
    """Naive Bayes over ``PLACES`` from (kind, place, value, mass of personal data, mass of the rest): log-odds by kind."""
    out = {}
    for kind in ALL_KINDS:
        mass = {(p, v): (g, b) for k, p, v, g, b in counts if k == kind}
        good, bad = (1 + sum(m[i] for (p, _), m in mass.items() if p == 0) for i in (0, 1))
        table = []
        for p, size in enumerate(PLACES):
            cells = [mass.get((p, v), (0.0, 0.0)) for v in range(size)]
            table.append([math.log((g + 1 / size) / good) - math.log((b + 1 / size) / bad) for g, b in cells])
        out[kind] = (math.log(good / bad), table)
    return out


def _odds(model: tuple[float, list[list[float]]], seen: Column) -> Column:
    """Log-odds under ``model`` of an array of numbers, one for each place."""
    start, table = model
    total = F.lit(float(start))
    for i, weights in enumerate(table):
        total = total + F.element_at(F.expr(f"array({', '.join(f'{w!r}D' for w in weights)})"), F.element_at(seen, i + 1) + 1)
    return total


def find(docs: DataFrame, threshold: float = 0.5, gazetteers: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, added.

    Base spans are the leftmost non-overlapping matches of ``BASE`` that are ``valid``; they always stay and are what
    the first four counts and base_sha256 speak of. Looser candidates of these kinds and of secrets (keys, tokens) that
    touch no base span are added to ``spans`` where the final classifier gives them more than ``threshold``; ``added``
    counts them, ``n_secret`` those that are secrets. Five labelers (pattern, gazetteer, words before, words after, marks
    around) vote on all candidates, base spans among them; expectation-maximisation estimates how far each can be
    trusted, and its posteriors train the classifier, which also sees the candidate's shape and the words next to it.
    ``gazetteers`` replaces entries of ``GAZETTEERS``. Votes and features are counted over the whole corpus; at most
    1,215 and 535 counts reach the driver, whatever the corpus.

    ``spans`` holds kind:start:end in code points, end exclusive, by kind as in ``ALL_KINDS`` and then start.

    Whole texts are searched once, in place, and the spans written to the shared folder; nothing but counts is shuffled.
    Work grows with the text and its matches.

    Nulls and edge cases: null and empty texts have no span; an empty table has no rows; repeated rows are reported
    each; ids may be null; extra columns are ignored.
    """
    text = F.col("text")
    lists = GAZETTEERS | (gazetteers or {})
    src = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cols = []
    for kind in ALL_KINDS:
        gate = text.rlike(GATE[kind])
        if kind in BASE:
            cols.append(spans(text, BASE[kind], gate, lambda v, k=kind: valid(k, v)).alias(f"base_{kind}"))
        cols.append(spans(text, LOOSE[kind], gate).alias(f"loose_{kind}"))
    found = src.select("doc_id", *cols).withColumn("taken", F.concat(*[f"base_{k}" for k in KINDS]))

    def told(kind: str, base: bool):
        def of(x: Column) -> Column:
            seen = F.array(*[c.cast("int") for c in [*_votes(kind, x, base, lists), *_around(x)]])
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), seen.alias("seen"))

        return of

    slim = [F.transform(f"base_{k}", told(k, True)).alias(f"base_{k}") for k in KINDS]
    slim += [F.transform(apart(F.col(f"loose_{k}"), F.col("taken")), told(k, False)).alias(f"loose_{k}") for k in ALL_KINDS]
    found = stored(found.select("doc_id", *slim), "spans")
    columns = [(k, c) for k in ALL_KINDS for c in (f"base_{k}", f"loose_{k}") if c in found.columns]

    def named(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x["seen"].alias("seen"))

    every = F.concat(*[F.transform(c, named(k)) for k, c in columns])
    each = found.select(F.explode(every).alias("x")).select("x.kind", "x.seen")
    votes = F.array_join(F.slice("seen", 1, LABELERS), "")
    trust = estimate([(r["kind"], r["votes"], r["count"]) for r in each.groupBy("kind", votes.alias("votes")).count().collect()])

    def chance(kind: str, model: dict, seen: Column) -> Column:
        return 1 / (1 + F.exp(-_odds(model[kind], seen)))

    p = F.lit(0.0)
    for k in ALL_KINDS:
        p = F.when(F.col("kind") == k, chance(k, trust, F.col("seen"))).otherwise(p)
    told_ = each.withColumn("p", p).select("kind", "p", F.posexplode("seen").alias("place", "value"))
    counts = told_.groupBy("kind", "place", "value").agg(F.sum("p").alias("g"), F.sum(1 - F.col("p")).alias("b")).orderBy("kind", "place", "value")
    model = classifier([(r["kind"], r["place"], r["value"], r["g"], r["b"]) for r in counts.collect()])
    cut = math.log(threshold / (1 - threshold))

    def above(kind: str):
        return lambda x: _odds(model[kind], x["seen"]) > cut

    out = found.select("doc_id", *[f"base_{k}" for k in KINDS], *[F.filter(f"loose_{k}", above(k)).alias(f"more_{k}") for k in ALL_KINDS])

    def listed(*sets: str) -> Column:
        parts = []
        for k in ALL_KINDS:
            have = [F.col(f"{s}_{k}") for s in sets if f"{s}_{k}" in out.columns]
            if have:
                at = F.array_sort(F.transform(F.concat(*have), lambda x: F.struct(x["start"], x["end"])))
                parts.append(F.transform(at, _written(k)))
        return F.array_join(F.concat(*parts), ",")

    return out.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("base", "more").alias("spans"),
        F.size("more_secret").cast("long").alias("n_secret"),
        sum((F.size(f"more_{k}") for k in ALL_KINDS), F.lit(0)).cast("long").alias("added"),
    )


def _written(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))
