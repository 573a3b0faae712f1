"""Signals as rows of samples: peaks, loudness, envelopes, gating, bit depth and resampling.

Functions on a *sample array* take one row per signal chunk (interleaved samples). Chunks hold a multiple of the bucket
and of the gate window, so those two never need neighbours and are maps without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions import scalars as S

BUCKET = 512


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def max_abs(samples: Column | str) -> Column:
    return F.coalesce(F.array_max(F.transform(_c(samples), lambda x: F.abs(x.cast("int")))), F.lit(0))


def _blocks(samples: Column, size: Column, whole_only: bool) -> Column:
    n = F.size(samples)
    count = F.floor(n / size) if whole_only else F.ceil(n / size)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.slice(samples, (i * size + 1).cast("int"), size))).otherwise(
        F.array().cast("array<array<int>>")
    )


def bucket_peaks(samples: Column | str, bucket: int = BUCKET, channels: Column | str | int = 1) -> Column:
    """Peak of every whole bucket of ``bucket`` frames over all channels; a partial last bucket is dropped."""
    ch = F.lit(channels) if isinstance(channels, int) else _c(channels)
    return F.transform(_blocks(F.transform(_c(samples), lambda x: x.cast("int")), (ch * bucket).cast("int"), True), max_abs)


def peak_db(samples: Column | str) -> Column:
    return S.linear_to_db(max_abs(samples) / F.lit(32768.0))


def silence_gate(samples: Column | str, threshold: Column | int, window: int = S.GATE_WINDOW, channels: Column | str | int = 1) -> Column:
    """Blocks of ``window`` frames without a sample of at least the threshold become zero, the partial last one too.

    A NULL threshold gates nothing."""
    ch = F.lit(channels) if isinstance(channels, int) else _c(channels)
    t = F.lit(threshold) if isinstance(threshold, int) else threshold

    def gate(ints: Column) -> Column:
        loud = lambda b: F.when(max_abs(b) >= t, b).otherwise(F.transform(b, lambda x: F.lit(0)))
        return F.when(t.isNull(), ints).otherwise(F.flatten(F.transform(_blocks(ints, (ch * window).cast("int"), False), loud)))

    return S.let(F.transform(_c(samples), lambda x: x.cast("int")), gate)


# The coefficients of the powers of the place, for the sums (even powers) and the differences (odd ones) of the
# three symmetric pairs of points, from the inner pair outward.
COEFFICIENTS = {
    0: (0.426859834093794, 0.0723812351117003, 0.00075893079450573),
    1: (0.358317723488933, 0.204516445547583, 0.00562658797241955),
    2: (-0.217009177221292, 0.200513765940862, 0.0164954112804021),
    3: (-0.25112715343741, 0.0422302599220046, 0.0248872747299513),
    4: (0.0416694667353327, -0.0625042011435699, 0.020834734408418),
    5: (0.0834979923567504, -0.0417491284163099, 0.00834987866042734),
}


def _poly(x: Column, p: Sequence[Column]) -> Column:
    """Six-point, fifth-order interpolation at x in [0, 1) between the third and the fourth point."""
    sums, diffs = [p[3] + p[2], p[4] + p[1], p[5] + p[0]], [p[3] - p[2], p[4] - p[1], p[5] - p[0]]
    z, out = x - 0.5, None
    for k in range(5, -1, -1):
        term = sum((w * c for w, c in zip(COEFFICIENTS[k], sums if k % 2 == 0 else diffs, strict=True)), F.lit(0.0))
        out = term if out is None else out * z + term
    return out


def resample(samples: Column | str, frames_out: Column | int, channels: int = 1) -> Column:
    """A whole signal (one row) at another length: positions i / out * in, six points, wrapping at the ends.

    There is no low-pass. For signals in several rows see ``resample_chunks``."""
    out = F.lit(frames_out) if isinstance(frames_out, int) else frames_out

    def whole(s: Column) -> Column:
        n = F.floor(F.size(s) / channels)

        def at(i: Column, c: int) -> Column:
            def sample(pos: Column) -> Column:
                base = F.floor(pos)
                points = [F.element_at(s, (F.pmod(base + k, n) * channels + c + 1).cast("int")) for k in (-2, -1, 0, 1, 2, 3)]
                return S.let(F.array(*points, pos - base), lambda p: F.least(F.greatest(_poly(p[6], [p[j] for j in range(6)]), F.lit(-32767.0)), F.lit(32767.0)).cast("int"))

            return S.let(i / out * n, sample)

        frames = F.transform(F.sequence(F.lit(0).cast("long"), out - 1), lambda i: F.array(*[at(i.cast("double"), c) for c in range(channels)]))
        return F.when((out > 0) & (n > 0), F.flatten(frames)).otherwise(F.array().cast("array<int>"))

    return S.let(F.transform(_c(samples), lambda x: x.cast("double")), whole)


def resample_chunks(chunks: DataFrame, frames_in: int | str | Column, frames_out: int | str | Column, chunk_frames: int, asset: str = "asset", channels: int | str | Column = 1) -> DataFrame:
    """Resampling of signals in rows (asset, chunk_no, samples) of ``chunk_frames`` frames (at least four), the last one
    of any length: (asset, chunk_no, samples) in rows of as many frames again. See ``_resampled``."""
    n, out, ch = (F.lit(x) if isinstance(x, int) else _c(x) for x in (frames_in, frames_out, channels))
    facts = chunks.select(asset, "chunk_no", F.floor(F.size("samples") / ch).alias("__len"), n.cast("long").alias("__n"), out.cast("long").alias("__out"))
    return _resampled(chunks.select(asset, "chunk_no", "samples", ch.cast("int").alias("__ch")), facts, chunk_frames, asset)


def _halos(chunks: DataFrame, facts: DataFrame, chunk_frames: int, asset: str) -> DataFrame:
    """(asset, chunk_no, __n, __out, __start, __before, __after): the three frames before every row and the four behind it.

    Halos are messages: each row sends its first four and last three frames, one small row a frame, keyed by signal and
    place; each row asks for seven places, which wrap at the ends of the signal. No row's samples move here."""
    ch, start = F.col("__ch"), F.col("chunk_no") * chunk_frames
    size = F.floor(F.size("samples") / ch)
    at = F.array_union(F.sequence(F.lit(0).cast("long"), F.least(size, F.lit(4)) - 1), F.sequence(F.greatest(size - 3, F.lit(0)), size - 1))
    sent = chunks.filter(F.size("samples") > 0).select(asset, start.alias("__start"), "__ch", "samples", F.explode(at).alias("__j"))
    frame = F.transform(F.slice("samples", (F.col("__j") * ch + 1).cast("int"), ch), lambda x: x.cast("int"))
    sent = sent.select(asset, (F.col("__start") + F.col("__j")).alias("__at"), frame.alias("__frame"))
    place = F.when(F.col("__k") < 3, F.col("__start") - 3 + F.col("__k")).otherwise(F.col("__start") + F.col("__len") + F.col("__k") - 3)
    asked = facts.filter("__n > 0 and __out > 0 and __len > 0").withColumns({"__start": start, "__k": F.explode(F.sequence(F.lit(0), F.lit(6)))})
    asked = asked.withColumn("__at", F.pmod(place, F.col("__n")))
    got = asked.join(sent, [asset, "__at"]).groupBy(asset, "chunk_no", "__n", "__out", "__start").agg(F.array_sort(F.collect_list(F.struct("__k", "__frame"))).alias("h"))
    part = lambda lo, n: F.flatten(F.transform(F.slice("h", lo, n), lambda x: x["__frame"]))
    return got.select(asset, "chunk_no", "__n", "__out", "__start", part(1, 3).alias("__before"), part(4, 4).alias("__after"))


def _resampled(chunks: DataFrame, facts: DataFrame, chunk_frames: int, asset: str) -> DataFrame:
    """``chunks`` (asset, chunk_no, samples, __ch, further columns that are equal throughout a signal) at another length;
    ``facts`` (asset, chunk_no, __len, __n, __out) has the frames of row, signal and result.

    Each output frame reads from its own row and its halo (one frame more than it needs, as positions are rounded). A row
    meets its halo by (signal, row), what it yields is cut at the bounds of the new rows, and each of these gathers its few
    pieces, again by (signal, row): nothing brings a signal into one task."""
    if chunk_frames < 4:
        raise ValueError("a row has to hold four frames")
    carried = [c for c in chunks.columns if c not in (asset, "chunk_no", "samples", "__ch")]
    local = chunks.join(_halos(chunks, facts, chunk_frames, asset), [asset, "chunk_no"])
    stop = F.col("__start") + F.floor(F.size("samples") / F.col("__ch"))
    local = local.select(
        asset, *carried, "__n", "__out", "__ch", "__start", F.concat("__before", F.transform("samples", lambda x: x.cast("int")), "__after").alias("__local"),
        F.ceil(F.col("__start") * F.col("__out") / F.col("__n")).alias("__lo"),
        F.least(F.ceil(stop * F.col("__out") / F.col("__n")), F.col("__out")).alias("__hi"),
    ).filter("__lo < __hi")
    pieces = local.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("__lo") / chunk_frames), F.floor((F.col("__hi") - 1) / chunk_frames))))
    lo, hi = F.greatest("__lo", F.col("chunk_no") * chunk_frames), F.least("__hi", (F.col("chunk_no") + 1) * chunk_frames)

    def frame(i: Column) -> Column:
        def at(pos: Column) -> Column:
            base = F.floor(pos)

            def sample(c: Column) -> Column:
                points = [F.element_at("__local", ((base - F.col("__start") + 3 + k) * F.col("__ch") + c + 1).cast("int")).cast("double") for k in (-2, -1, 0, 1, 2, 3)]
                return S.let(F.array(*points, pos - base), lambda p: F.least(F.greatest(_poly(p[6], [p[j] for j in range(6)]), F.lit(-32767.0)), F.lit(32767.0)).cast("int"))

            return F.transform(F.sequence(F.lit(0), F.col("__ch") - 1), sample)

        return S.let(i.cast("double") / F.col("__out") * F.col("__n"), at)

    pieces = pieces.select(asset, "chunk_no", *carried, lo.alias("__at"), F.flatten(F.transform(F.sequence(lo, hi - 1), frame)).alias("__piece"))
    whole = F.array_sort(F.collect_list(F.struct("__at", "__piece")))
    out = pieces.groupBy(asset, "chunk_no").agg(F.flatten(F.transform(whole, lambda x: x["__piece"])).alias("samples"), *[F.min_by(c, "__at").alias(c) for c in carried])
    return out.select(asset, "chunk_no", "samples", *carried)


def hop_sums(chunks: DataFrame, width: int, hop: int, chunk_frames: int, asset: str = "asset", channels: int | str | Column = 1) -> DataFrame:
    """(asset, channel, b, full, head): the sum of squares of every hop [b * hop, (b + 1) * hop) of a channel, and of the
    first ``width % hop`` frames of it.

    Rows give the sums of what they hold of each hop, so hops that cross rows are two or more partial sums, which are
    combined before the shuffle. There is a row per hop, none per frame."""
    ch, rest = F.lit(channels) if isinstance(channels, int) else _c(channels), width % hop
    start = (F.col("chunk_no") * chunk_frames).cast("long")
    rows = chunks.filter(F.size("samples") > 0).select(asset, start.alias("__s"), (start + F.floor(F.size("samples") / ch)).alias("__e"), ch.cast("int").alias("__ch"), F.transform("samples", lambda x: x.cast("long")).alias("__x"))
    rows = rows.filter("__e > __s").withColumn("b", F.explode(F.sequence(F.floor(F.col("__s") / hop), F.floor((F.col("__e") - 1) / hop))))

    def squares(lo: Column, hi: Column) -> Column:
        """Of every channel, over the frames from lo to hi."""
        part = F.slice("__x", ((lo - F.col("__s")) * F.col("__ch") + 1).cast("int"), (F.greatest(hi - lo, F.lit(0)) * F.col("__ch")).cast("int"))
        one = lambda p, c: F.aggregate(F.filter(p, lambda x, i: i % F.col("__ch") == c), F.lit(0).cast("long"), lambda t, x: t + x * x)
        return S.let(part, lambda p: F.transform(F.sequence(F.lit(0), F.col("__ch") - 1), lambda c: one(p, c)))

    lo, hi = F.greatest(F.col("b") * hop, F.col("__s")), F.least((F.col("b") + 1) * hop, F.col("__e"))
    rows = rows.withColumn("v", F.arrays_zip(squares(lo, hi).alias("full"), squares(lo, F.least(hi, F.greatest(F.col("b") * hop + rest, lo))).alias("head")))
    rows = rows.select(asset, "b", F.posexplode("v").alias("channel", "v")).select(asset, "channel", "b", "v.full", "v.head")
    return rows.groupBy(asset, "channel", "b").agg(F.sum("full").alias("full"), F.sum("head").alias("head"))


def windowed_rms_db(chunks: DataFrame, width: int, hop: int | None = None, chunk_frames: int = 4096, asset: str = "asset", channels: int | str | Column = 1) -> DataFrame:
    """(asset, channel, rms_db): the largest root mean square of the windows [k * hop, k * hop + width) that end before
    the last frame, in dBFS, of signals in rows (asset, chunk_no, samples).

    A window is ``width // hop`` whole hops and the head of the next: each hop's sum goes to the few windows that hold it.
    Sums are exact integers. Signals not longer than a window have -80."""
    hop = hop or max(1, width // 5)
    ch, whole = F.lit(channels) if isinstance(channels, int) else _c(channels), width // hop
    n = chunks.groupBy(asset).agg(F.sum(F.floor(F.size("samples") / ch)).alias("__n"), F.max(ch).cast("int").alias("__ch"))
    sums = hop_sums(chunks, width, hop, chunk_frames, asset, channels)
    to = F.sequence(F.greatest(F.col("b") - whole, F.lit(0)), F.col("b"))  # the head counts in the window that ends there
    held = sums.select(asset, "channel", "b", "full", "head", F.explode(to).alias("__w"))
    held = held.groupBy(asset, "channel", "__w").agg(F.sum(F.when(F.col("b") - F.col("__w") == whole, F.col("head")).otherwise(F.col("full"))).alias("__q"))
    held = held.join(n.select(asset, "__n"), asset).filter(F.col("__w") * hop + width < F.col("__n"))
    best = held.groupBy(asset, "channel").agg(F.max("__q").alias("__q"))
    every = n.select(asset, F.explode(F.sequence(F.lit(0), F.col("__ch") - 1)).alias("channel"))
    rms = F.sqrt(F.col("__q") / F.lit(width)) / 32768.0
    return every.join(best, [asset, "channel"], "left").select(asset, "channel", F.coalesce(S.linear_to_db(rms), F.lit(S.FLOOR_DB)).alias("rms_db"))


def loudness(chunks: DataFrame, width: int, hop: int | None = None, chunk_frames: int = 4096, asset: str = "asset", channels: int | str | Column = 1) -> DataFrame:
    """(asset, peak_db, rms_db of the loudest channel, crest) of signals in rows."""
    peak = chunks.groupBy(asset).agg(S.linear_to_db(F.max(max_abs("samples")) / 32768.0).alias("peak_db"))
    rms = windowed_rms_db(chunks, width, hop, chunk_frames, asset, channels).groupBy(asset).agg(F.max("rms_db").alias("rms_db"))
    return peak.join(rms, asset).withColumn("crest", F.col("peak_db") - F.col("rms_db"))


# --- envelopes: one row per bucket, (asset, i, v) -------------------------------------------------------------------

def knots(buckets: DataFrame, asset: str = "asset", i: str = "i", v: str = "v") -> DataFrame:
    """Local maxima of each signal's buckets with both ends, as (asset, i, v, seq); a place may come twice.

    A bucket is a maximum if it is above the next one and the last change before it was a rise (or there was none); the
    last but one counts by its last change and by the fall before it. Of equal consecutive values only the first and
    the last stay. Everything is a window over the buckets of one signal, a row for every 512 frames of it."""
    w = Window.partitionBy(asset).orderBy(i)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy(asset))
    df = buckets.select(asset, F.col(i).alias("i"), F.col(v).alias("v"), n.alias("n"))
    df = df.withColumns({"next": F.lead("v").over(w), "step": F.signum(F.col("v") - F.lag("v").over(w))})
    df = df.withColumn("dir", F.last(F.when(F.col("step") != 0, F.col("step")), ignorenulls=True).over(upto))
    # the last fall before a place, and the first rise after it
    df = df.withColumn("fall", F.max(F.when(F.col("step") < 0, F.col("i"))).over(upto))
    rising = F.min(F.when(F.col("step") > 0, F.col("i"))).over(Window.partitionBy(asset, "fall").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("rise", rising)
    up = F.coalesce(F.col("dir"), F.lit(1.0)) > 0
    inner = (F.col("i") <= F.col("n") - 3) & (F.col("v") > F.col("next")) & up
    late = (F.col("i") == F.col("n") - 2) & (F.col("n") >= 3) & up & (F.col("fall").isNull() | F.coalesce(F.col("rise") <= F.col("n") - 3, F.lit(False)))
    pushes = F.array(
        F.struct(F.lit(0).alias("o"), (F.col("i") == 0).alias("keep")),
        F.struct(F.lit(1).alias("o"), (inner | late).alias("keep")),
        F.struct(F.lit(2).alias("o"), (F.col("i") == F.col("n") - 1).alias("keep")),
    )
    p = df.withColumn("p", F.explode(F.filter(pushes, lambda x: F.coalesce(x["keep"], F.lit(False)))))
    p = p.select(asset, "i", "v", "n", F.when(F.col("p.o") == 0, -1).when(F.col("p.o") == 2, F.col("n")).otherwise(F.col("i")).alias("at"))
    return collapse_runs(p, asset)


def collapse_runs(p: DataFrame, asset: str, at: str = "at", v: str = "v") -> DataFrame:
    """Runs of equal consecutive values shrink to their first and last; the final end always stays and ends no run."""
    w = Window.partitionBy(asset).orderBy(at)
    body = p.withColumns({"__prev": F.lag(v).over(w), "__next": F.lead(v).over(w), "__last": F.lead(at).over(w).isNull(), "__next_last": F.lead(at, 2).over(w).isNull()})
    keep = F.col("__last") | F.col("__next_last") | F.col("__prev").isNull() | (F.col("__prev") != F.col(v)) | (F.col("__next") != F.col(v))
    body = body.filter(keep).drop("__prev", "__next", "__last", "__next_last")
    return body.withColumn("seq", F.row_number().over(w) - 1).drop(at)


def smooth(buckets: DataFrame, ks: DataFrame, asset: str = "asset") -> DataFrame:
    """Buckets replaced by straight lines between their knots, all truncated to whole numbers; only a first bucket that
    is a knot twice keeps its fraction."""
    w = Window.partitionBy(asset).orderBy("i")
    k = ks.groupBy(asset, "i").agg(F.count("*").alias("k"))
    j = buckets.join(k, [asset, "i"], "left")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col("k") > 0, F.struct("i", "v"))
    j = j.withColumns({"__l": F.last(mark, ignorenulls=True).over(back), "__r": F.first(mark, ignorenulls=True).over(ahead)})
    t = (F.col("i") - F.col("__l.i")) / (F.col("__r.i") - F.col("__l.i"))
    line = F.when(F.col("__l").isNull(), F.col("v")).otherwise(F.col("__l.v") * (1 - t) + F.col("__r.v") * t)
    whole = F.when(line < 0, F.ceil(line)).otherwise(F.floor(line)).cast("double")
    return j.select(asset, "i", F.when(F.col("__l").isNull() & (F.col("k") > 1), F.col("v")).otherwise(whole).alias("v"))


def decimate(buckets: DataFrame, most: int = 32, asset: str = "asset", store=None) -> tuple[DataFrame, DataFrame]:
    """(buckets, knots): knots found and buckets smoothed between them until each signal has under ``most`` (at least 8).

    Each round works on the signals that are not done yet, until there are none: maxima of the smoothed line are maxima
    among the knots before, about half as many, so rounds grow with the logarithm of the longest signal. ``store``
    writes a frame to shared storage and reads it back (default: ``checkpoint``, which needs a checkpoint folder)."""
    if most < 8:
        raise ValueError("so few knots may never be reached")
    store = store or (lambda df: df.checkpoint())
    rest, done_b, done_k = buckets, [], []
    while True:
        ks = store(knots(rest, asset))
        many = ks.groupBy(asset).count().filter(F.col("count") >= most).select(asset)
        done_k.append(ks.join(many, asset, "left_anti"))
        done_b.append(rest.join(many, asset, "left_anti"))
        rest = store(smooth(rest.join(many, asset, "left_semi"), ks, asset))
        if rest.isEmpty():
            break
    b, k = done_b[0], done_k[0]
    for x, y in zip(done_b[1:], done_k[1:], strict=True):
        b, k = b.unionByName(x), k.unionByName(y)
    return b, k


def candidates(ks: DataFrame, asset: str = "asset", most: int = 64) -> DataFrame:
    """Envelopes of four points: (asset, ordinal, level[4], time[4]) of signals with under ``most`` knots.

    With up to four knots the two in the middle; else every pair of inner knots but the last one. Knots are few bytes that
    become many candidates, so they are dealt over as many tasks as a shuffle has, which adaptive execution doesn't merge."""
    ks = ks.repartition(int(ks.sparkSession.conf.get("spark.sql.shuffle.partitions")), asset)
    size = ks.groupBy(asset).agg(F.count("*").alias("m"), F.min_by("v", "seq").alias("v0"), F.max_by("v", "seq").alias("v3"))
    k = ks.join(size, asset)
    left, right = k.alias("a"), k.select(asset, F.col("seq").alias("seq2"), F.col("i").alias("i2"), F.col("v").alias("v2")).alias("b")
    m, x, y = F.col("m"), F.col("seq"), F.col("seq2")
    few = (m <= 4) & (x == F.floor(m / 2) - 1) & (y == F.floor(m / 2))
    many = (m > 4) & (x >= 1) & (x < m - 2) & (y > x) & (y < m - 2)
    j = left.join(right, asset).filter(few | many)
    return j.select(
        asset,
        (x * most + y).alias("ordinal"),
        F.array("v0", "v", "v2", "v3").alias("level"),
        F.array(F.lit(0.0), F.col("i") / F.col("n"), F.col("i2") / F.col("n"), F.lit(1.0)).alias("time"),
        "n",
    )


def score_candidates(cands: DataFrame, buckets: DataFrame, asset: str = "asset") -> DataFrame:
    """The candidate of least mean squared error against the buckets, to eight places; of equal ones the first. The last
    bucket has no error, as the lines end there.

    The squared distance of a line from a stretch of buckets is made of their number and running sums of v, i * v and
    v * v, so a candidate reads four rows of the buckets, however long the signal is. Such sums can't tell candidates that
    draw the same line, so those about as good as the best (mostly one) are then compared bucket by bucket."""
    before = Window.partitionBy(asset).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    v, i = F.col("v"), F.col("i").cast("double")
    sums = F.struct(*[F.coalesce(F.sum(x).over(before), F.lit(0.0)).alias(name) for name, x in (("v", v), ("iv", i * v), ("vv", v * v))])
    at = buckets.select(asset, F.col("i").cast("long").alias("q"), sums.alias("s"))
    c = cands.withColumns({"q1": F.floor(F.col("time")[1] * (F.col("n") - 1)), "q2": F.floor(F.col("time")[2] * (F.col("n") - 1)), "q3": (F.col("n") - 1).cast("long")})
    for k in (1, 2, 3):
        c = c.join(at.withColumnsRenamed({"q": f"q{k}", "s": f"s{k}"}), [asset, f"q{k}"])
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("iv"), F.lit(0.0).alias("vv"))

    def error(lo: Column, hi: Column, s: Column, t: Column, left: Column, right: Column) -> Column:
        n = (hi - lo).cast("double")
        slope = (right - left) / n
        sv, siv, svv = (t[x] - s[x] for x in ("v", "iv", "vv"))
        jv = siv - lo * sv  # places within the stretch
        total = n * left * left + left * slope * n * (n - 1) + slope * slope * (n - 1) * n * (2 * n - 1) / 6 - 2 * left * sv - 2 * slope * jv + svv
        return F.when(hi > lo, total).otherwise(0.0)

    level = F.col("level")
    sums = (
        error(F.lit(0).cast("long"), F.col("q1"), zero, F.col("s1"), level[0], level[1])
        + error(F.col("q1"), F.col("q2"), F.col("s1"), F.col("s2"), level[1], level[2])
        + error(F.col("q2"), F.col("q3"), F.col("s2"), F.col("s3"), level[2], level[3])
    )
    each = Window.partitionBy(asset)
    scored = c.select(asset, (sums / F.col("n")).alias("s"), (F.col("s3.vv") / F.col("n")).alias("__power"), "ordinal", "level", "time", "n", "q1", "q2", "q3")
    close = scored.withColumn("__least", F.min("s").over(each)).filter(F.col("s") - F.col("__least") <= 1e-7 + 1e-10 * F.col("__power"))
    line = buckets.groupBy(asset).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("__v"))
    exact = close.join(line, asset).select(asset, (_line_error("__v") / F.col("n")).alias("s"), "ordinal", "level", "time")
    scaled = F.col("s") * 1e8
    whole = F.floor(scaled).cast("double")
    rounded = F.when(scaled >= 2.0**52, scaled).when(scaled - whole >= 0.5, whole + 1).otherwise(whole)  # whole numbers from there on
    best = exact.groupBy(asset).agg(F.min(F.struct(rounded.alias("s"), "ordinal", "level", "time")).alias("x"))
    return best.select(asset, (F.col("x.s") / 1e8).alias("score"), "x.ordinal", "x.level", "x.time")


def _line_error(values: str) -> Column:
    """The squared errors of the three lines of a candidate (level, q1, q2, q3) at each bucket but the last, added in their order."""

    def between(i: Column, lo: Column, hi: Column, left: int) -> Column:
        t = (i - lo) / (hi - lo)
        return F.col("level")[left] * (1 - t) + F.col("level")[left + 1] * t

    def squared(v: Column, i: Column) -> Column:
        at = F.when(i < F.col("q1"), between(i, F.lit(0), F.col("q1"), 0)).when(i < F.col("q2"), between(i, F.col("q1"), F.col("q2"), 1)).otherwise(between(i, F.col("q2"), F.col("q3"), 2))
        return S.let(at - v, lambda e: e * e)

    return F.aggregate(F.transform(F.slice(values, F.lit(1), F.col("q3").cast("int")), squared), F.lit(0.0), lambda t, x: t + x)


def short_envelope(peak: Column) -> tuple[Column, Column]:
    """Levels and times of a signal of at most one bucket: its linear peak throughout."""
    p = peak / F.lit(32768.0)
    return F.array(p, p, p, p), F.array(*[F.lit(x) for x in (0.0, 0.3, 0.6, 1.0)])


def peaks_of_chunks(chunks: DataFrame, bucket: int = BUCKET, chunk_frames: int = 4096, asset: str = "asset") -> DataFrame:
    """(asset, i, peak) of signals in rows, without a shuffle."""
    return _peaks_of(summaries(chunks, bucket, asset), bucket, chunk_frames, asset)


def summaries(chunks: DataFrame, bucket: int = BUCKET, asset: str = "asset") -> DataFrame:
    """(asset, chunk_no, channel_count, frame_rate, frames, peak, peaks) of rows of signals, a map: all that an envelope
    needs of the samples, in a ``bucket``-th of their size, so that it can be kept and the signals are read once."""
    rate = F.col("frame_rate") if "frame_rate" in chunks.columns else F.lit(None).cast("int").alias("frame_rate")
    return chunks.select(
        asset, "chunk_no", "channel_count", rate,
        F.floor(F.size("samples") / F.col("channel_count")).cast("long").alias("frames"),
        max_abs("samples").alias("peak"),
        bucket_peaks("samples", bucket, "channel_count").alias("peaks"),
    )


def _peaks_of(summary: DataFrame, bucket: int, chunk_frames: int, asset: str) -> DataFrame:
    p = summary.select(asset, "chunk_no", F.posexplode("peaks").alias("j", "peak"))
    return p.select(asset, (F.col("chunk_no") * (chunk_frames // bucket) + F.col("j")).cast("int").alias("i"), "peak")


def envelope(chunks: DataFrame, bucket: int = BUCKET, chunk_frames: int = 4096, most: int = 32, asset: str = "asset", store=None) -> DataFrame:
    """(asset, level[4], time[4]) of every signal, from its original samples, which are read once if ``store`` is given."""
    summary = summaries(chunks, bucket, asset)
    return envelope_of(store(summary) if store else summary, bucket, chunk_frames, most, asset, store)


def envelope_of(summary: DataFrame, bucket: int = BUCKET, chunk_frames: int = 4096, most: int = 32, asset: str = "asset", store=None) -> DataFrame:
    """``envelope`` of signals whose ``summaries`` are known."""
    peaks = _peaks_of(summary, bucket, chunk_frames, asset).select(asset, "i", S.linear_to_spl(F.col("peak") / 32768.0).alias("v"))
    count = summary.groupBy(asset).agg(F.max("peak").alias("peak"), F.sum("frames").alias("frames"))
    long_ = count.filter(F.col("frames") >= 2 * bucket).select(asset)
    b, k = decimate(peaks.join(long_, asset, "left_semi"), most, asset=asset, store=store)
    best = score_candidates(candidates(k, asset, most), b, asset).select(asset, "level", "time")
    level, time = short_envelope(F.col("peak"))
    return best.unionByName(count.filter(F.col("frames") < 2 * bucket).select(asset, level.alias("level"), time.alias("time")))


def condition(signals: DataFrame, level: str = "level", to: int = 48000) -> DataFrame:
    """One row per signal (samples, channel_count, frame_rate, level): resampled, then gated, then cut in bit depth."""

    def at_rate(channels: int) -> Column:
        n = F.floor(F.size("samples") / channels)
        return F.when(F.col("frame_rate") == to, F.transform("samples", lambda x: x.cast("int"))).otherwise(
            resample("samples", S.resampled_frames(n, F.col("frame_rate"), to), channels)
        )

    s = signals.withColumn("samples", F.when(F.col("channel_count") == 2, at_rate(2)).otherwise(at_rate(1))).withColumn("frame_rate", F.lit(to))
    s = s.withColumn("samples", silence_gate("samples", S.gate_threshold(level), channels="channel_count"))
    return s.withColumn("samples", S.truncate_bits("samples", level))


def condition_chunks(chunks: DataFrame, level: str = "level", to: int = 48000, chunk_frames: int = 4096, window: int = S.GATE_WINDOW, asset: str = "asset") -> DataFrame:
    """``condition`` of signals in rows (asset, chunk_no, channel_count, frame_rate, level, samples) of ``chunk_frames``
    frames, a multiple of the gate's window: the same columns, of signals of any length.

    Signals that have the rate already (or no frame) are a map. Of the others the frames are counted by a narrow
    aggregate, halos are messages of seven frames a row, and samples move by (signal, row) only."""
    if chunk_frames % window:
        raise ValueError("rows have to hold whole windows")
    facts = ["channel_count", "frame_rate", level]
    as_is = (F.col("frame_rate") == to) | (F.size("samples") == 0)
    other = chunks.filter(~as_is)
    size = other.select(asset, "chunk_no", "frame_rate", F.floor(F.size("samples") / F.col("channel_count")).alias("__len"))
    total = size.groupBy(asset).agg(F.sum("__len").alias("__n"), F.max("frame_rate").alias("__rate"))
    total = total.select(asset, "__n", S.resampled_frames(F.col("__n"), F.col("__rate"), to).cast("long").alias("__out"))
    rows = other.select(asset, "chunk_no", "samples", F.col("channel_count").cast("int").alias("__ch"), *facts)
    done = _resampled(rows, size.join(total, asset).select(asset, "chunk_no", "__len", "__n", "__out"), chunk_frames, asset)
    same = chunks.filter(as_is).withColumn("samples", F.transform("samples", lambda x: x.cast("int")))
    s = same.select(asset, "chunk_no", *facts, "samples").unionByName(done.select(asset, "chunk_no", *facts, "samples"))
    return gated_chunks(s, level, window).withColumn("frame_rate", F.lit(to))


def gated_chunks(chunks: DataFrame, level: str = "level", window: int = S.GATE_WINDOW) -> DataFrame:
    """``condition_chunks`` of signals that have the rate already: gated, then cut in bit depth, a map."""
    s = chunks.withColumn("samples", silence_gate("samples", S.gate_threshold(level), window, "channel_count"))
    return s.withColumn("samples", S.truncate_bits("samples", level))
