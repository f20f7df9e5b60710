"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its distinct words (runs without white space). A line goes
if an earlier line, in the order of (doc_id, line number), has the same set or
one with Jaccard similarity of at least ``threshold``.

1. Words are counted over all lines in a fixed number of hashed slots. A word's
   key is its slot's count followed by its hash: one total order for all words,
   rare before frequent, that needs no table of words.
2. Each distinct set is its sorted keys. Only the first n - ceil(t n) + 1 of its n
   keys (the prefix) can decide: two sets as similar as t share a prefix key.
3. Prefixes are joined on the key, with the length filter (t n <= m), the
   positional filter (what follows the shared key can still reach the overlap)
   and a parity signature: the xor of one bit per word bounds the number of words
   that differ from below. A frequent key is split by AQE like any skewed join.
4. A set goes whole as soon as one earlier set is similar, so candidates are
   verified by their words in rounds. The first round offers each set the earliest
   set of its rarest keys, one row per set and key: a group of near copies settles
   there without its pairs. What is left asks for its ``MORE`` likeliest candidates,
   the keys in batches: a set that has found a similar one does not ask the next
   batch. Sets that had as many candidates and saw them all fail ask all keys for
   more at once, until none is left; with fewer, all there are have been seen.
5. A set without a similar earlier one keeps its first line alone.

Equal sets never meet as pairs: they are collapsed before the join. Lines without
a word are kept and match nothing. Null texts stay null. Rows with the same doc_id
keep their own lines; lines of equal number in them are the same place, neither
later than the other, so repeated rows get the same result. A null doc_id comes
first. An empty table gives no rows. All other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ownergraph.llm.common import discard, release, stored

THRESHOLD = 0.8
SLOTS = 1 << 16
HASH_BITS = 51
SIGNS = ["sig0", "sig1"]  # parity signature: 64 bits each
LEADING = 4  # prefix keys whose earliest set is the first candidate
SHARES = (1, 1, 2, 4, 8)  # of the keys, in which they are taken when all sets ask; few first, as they settle most of a group
NAMED = 500_000  # rows (places of first lines, postings, numbers) sent to every task at most
MORE = 8  # candidates a set at first, times as many in each further round


def _plain(text: Column) -> Column:
    """``text`` with other white space inside lines made spaces. Most texts hold none:
    finding that out takes far less than a translation."""
    other = F.contains(text, F.lit("\t"))
    for c in "\r\x0b\f":
        other = other | F.contains(text, F.lit(c))
    return F.when(other, F.translate(text, "\t\r\x0b\f", "    ")).otherwise(text)


def _lines(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, line_no, line) of all lines with a word; ``row`` is the text's
    hash and tells rows with the same doc_id apart. Other white space inside a line
    is made spaces. ``rows(row)``: only the lines of these texts; the others are not
    split."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    if rows is not None:
        whole = whole.join(rows, "row", "left_semi")
    return (
        whole.select(
            "doc_id",
            "row",
            F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line_no", "line"),
        ).where(F.trim("line") != "")
    )


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _slot_counts(docs: DataFrame) -> Column:
    """Array literal with the word count of every slot, in the place that it takes in a
    key: ``SLOTS`` numbers, however large the input is."""
    words = docs.select(F.explode(F.split(F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    rows = words.groupBy(_slot(F.xxhash64("w")).alias("s")).count().collect()
    counts = ["0"] * SLOTS
    for r in rows:
        # Logarithmic steps of 1/64: the order matters, not the number.
        step = int(64 * (r["count"]).bit_length() + (r["count"] << 6 >> r["count"].bit_length()))
        counts[r["s"]] = str(step << HASH_BITS)
    return F.split(F.lit(",".join(counts)), ",").cast("array<bigint>")


def _slot(h: Column) -> Column:
    return h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _sets(docs: DataFrame, threshold: float) -> DataFrame:
    """Per line (doc_id, row, line_no, id, signature, n, prefix). What is done for each
    word is kept to few steps: Spark interprets them."""
    counts = _slot_counts(docs)

    def key(h: Column) -> Column:
        # Never null, so that the keys are sorted as plain numbers.
        return F.coalesce(F.get(counts, _slot(h)), F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))

    def sign(half: Column) -> Column:
        # A word's lowest bits name its bit.
        def flip(a: Column, x: Column) -> Column:
            return a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))

        return F.aggregate(half, F.lit(0).cast("long"), flip)

    # The empty strings between spaces are left out by their hash.
    hashes = F.array_distinct(F.array_remove(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))
    hashed = _lines(docs).select("doc_id", "row", "line_no", hashes.alias("h"))
    # The sign of a word's hash names its half of the signature.
    halves = [F.filter("h", lambda x: x < 0), F.filter("h", lambda x: x >= 0)]
    keyed = hashed.select(
        "doc_id",
        "row",
        "line_no",
        F.size("h").alias("n"),
        *[sign(half).alias(c) for half, c in zip(halves, SIGNS)],
        F.sort_array(F.transform("h", key)).alias("k"),
    )
    return keyed.select(
        "doc_id",
        "row",
        "line_no",
        "n",
        F.xxhash64("k").alias("id"),
        *SIGNS,
        F.slice("k", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")).alias("prefix"),
    )


def _posts(sets: DataFrame, keys: int | None = None) -> DataFrame:
    """One row per set and prefix key (the first ``keys`` of them)."""
    prefix = F.col("prefix") if keys is None else F.slice("prefix", 1, keys)
    return sets.select(*[c for c in sets.columns if c != "prefix"], F.posexplode(prefix).alias("pos", "key"))


def _near(a: str, b: str, threshold: float) -> tuple[Column, Column]:
    """(length and parity filters, words that differ at least) of two sets' columns."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    differ = sum((F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in SIGNS[1:]), F.bit_count(F.col(a + SIGNS[0]).bitwiseXOR(F.col(b + SIGNS[0]))))
    share = threshold / (1 + threshold)
    fits = (m >= n * threshold - 1e-9) & (n >= m * threshold - 1e-9) & (differ <= (n + m) * (1 - 2 * share) + 1e-9)
    return fits, differ


def _first_of_key(sets: DataFrame, threshold: float) -> DataFrame:
    """(s, differ, e): per set at most one candidate, the earliest set of one of its
    ``LEADING`` rarest keys. A group of near copies meets its first set here, one
    row a key and set, however large it is."""
    posts = _posts(sets, LEADING)
    heads = posts.groupBy("key").agg(F.min(F.struct("s", *SIGNS, "n")).alias("head"))
    fits, differ = _near("", "head.", threshold)
    return (
        posts.join(heads, "key")
        .where((F.col("head.s") < F.col("s")) & fits)
        .groupBy("s")
        .agg(F.min(F.struct(differ.alias("differ"), F.col("head.s").alias("e"))).alias("best"))
        .select("s", "best.differ", "best.e")
    )


def _batch(posts: DataFrame, i: int, batches: int, width: int = 1) -> DataFrame:
    """The postings of ``width`` of ``batches`` shares of the keys, from the share ``i``
    on, so that few move at once."""
    return posts if batches == width else posts.where(F.pmod(F.xxhash64("key"), F.lit(batches)).between(i, i + width - 1))


def _candidates(sets: DataFrame, asking: DataFrame, k: int, threshold: float, batches: int) -> DataFrame:
    """(s, differ, e): for every set s of ``asking(s, after)`` the ``k`` likeliest
    earlier sets e that pass all filters, in the order of (differ, e), beyond
    ``after`` (null: from the first). Pairs meet inside the join and are reduced
    there, per task, to ``k`` a set; they are not dealt out. The keys are taken in
    ``batches``. The postings of few sets are sent to all those of the others."""
    asked, best = stored(sets.join(_small(asking), "s"), "line-asked"), None
    for i in range(batches):
        part = stored(_best(_small(_batch(_posts(asked), i, batches)), _batch(_posts(sets), i, batches), k, threshold), "line-batch")
        best = part if best is None else best.unionByName(part)
        release(sets.sparkSession)
    discard(asked)
    return best if batches == 1 else _top(best.select("s", F.struct("differ", "e").alias("c")), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` least c of every s, as (s, differ, e). A pair may be given more
    than once."""
    if k == 1:
        best = found.groupBy("s").agg(F.min("c").alias("c"))
    else:
        # Equal pairs have one rank: each task keeps the first k of a set before any move.
        nearest = Window.partitionBy("s").orderBy("c")
        best = found.withColumn("r", F.dense_rank().over(nearest)).where(F.col("r") <= k).select("s", "c").distinct()
    return best.select("s", "c.differ", "c.e")


def _best(a: DataFrame, b: DataFrame, k: int, threshold: float) -> DataFrame:
    """``_candidates`` of the postings ``a`` among the postings ``b``."""
    again = "after" in a.columns
    a, b = a.alias("a"), b.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    fits, differ = _near("a.", "b.", threshold)
    # At the first shared key: it and what follows it in both can be shared.
    left = F.least(n - F.col("a.pos"), m - F.col("b.pos"))
    rank = F.struct(differ.alias("differ"), F.col("b.s").alias("e"))
    found = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("b.s") < F.col("a.s"))
        & fits
        & (left >= (n + m) * (threshold / (1 + threshold)) - 1e-9)
        & (F.col("a.after").isNull() | (rank > F.col("a.after")) if again else F.lit(True)),
    ).select(F.col("a.s").alias("s"), rank.alias("c"))
    return _top(found, k)


def _small(table: DataFrame) -> DataFrame:
    """``table``, sent to every task if it has at most ``NAMED`` rows."""
    return F.broadcast(table) if table.count() <= NAMED else table


def _verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Per set s with pairs: ``like`` (whether the words of s and of one e, read from
    their first lines, are similar and e's first line lies before that of s), the
    last of its pairs as ``after`` and their number n."""
    ends = pairs.select("s").union(pairs.select("e")).distinct()
    met = firsts.join(ends, "s").select("s", F.col("first.doc_id").alias("__d"), F.col("first.line_no").alias("__l"), F.col("row").alias("__r"))
    met = stored(met, "line-met")
    few = met.count() <= NAMED
    named = F.broadcast(met) if few else met
    lines = _lines(docs, F.broadcast(met.select(F.col("__r").alias("row")).distinct()) if few else None)
    texts = stored(
        lines.join(named, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("row") == F.col("__r")) & (F.col("line_no") == F.col("__l")))
        .select("s", "line", F.struct("doc_id", "line_no").alias("place")),
        "line-texts",
    )
    x = texts.select("s", F.col("line").alias("x"), F.col("place").alias("own"))
    y = texts.select(F.col("s").alias("e"), F.col("line").alias("y"), F.col("place").alias("cut"))
    y = y.join(pairs.select("e").distinct(), "e", "left_semi")
    # Exploding one element keeps the words from being worked out more than once.
    both = (
        pairs.join(y, "e")
        .join(x, "s")
        .select("s", "differ", "e", "own", "cut", F.explode(F.array(F.struct(F.array_distinct(_words(F.col("x"))).alias("u"), F.array_distinct(_words(F.col("y"))).alias("v")))).alias("w"))
        .select("s", "differ", "e", "own", "cut", F.size("w.u").alias("nu"), F.size("w.v").alias("nv"), F.explode(F.array(F.size(F.array_intersect("w.u", "w.v")))).alias("both"))
    )
    like = (F.col("both") >= (F.col("nu") + F.col("nv") - F.col("both")) * threshold - 1e-9) & (F.col("cut") < F.col("own"))
    # Repeated rows give the same pair again.
    out = stored(both.groupBy("s", "differ", "e").agg(F.max(like).alias("like")), "line-checked")
    discard(texts, met, pairs)
    release(docs.sparkSession)
    return out.groupBy("s").agg(F.max("like").alias("like"), F.max(F.struct("differ", "e")).alias("after"), F.count("*").alias("n"))


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row, line_no) of the lines that go."""
    spark = docs.sparkSession
    whole = stored(_sets(docs, threshold), "line-own")
    # The row tells whose line is the first, where rows share a doc_id.
    found = (
        whole.groupBy("id", *SIGNS, "n")
        .agg(F.min(F.struct("doc_id", "line_no", "row")).alias("head"), F.first("prefix").alias("prefix"))
        .select("id", *SIGNS, "n", F.struct("head.doc_id", "head.line_no").alias("first"), F.col("head.row").alias("row"), "prefix")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Numbered in the order of first lines: ranges, sorted, then rising ids.
    numbered = stored(
        found.repartitionByRange(parts, "first").sortWithinPartitions("first").withColumn("s", F.monotonically_increasing_id()),
        "line-sets",
    )
    own = stored(whole.drop("prefix"), "line-places")
    discard(whole)
    # Each step's shuffle files go before the next step makes its own.
    release(spark)
    sets = numbered.select("s", *SIGNS, "n", "prefix")
    firsts = numbered.select("s", "first", "row")
    n_sets = numbered.count()
    checked = _verified(stored(_first_of_key(sets, threshold), "line-pairs"), firsts, docs, threshold)
    good, failed, k = checked.where("like").select("s"), None, MORE
    for i, width in enumerate(SHARES):
        # What has found a similar set before asks no more.
        still = sets.join(_small(good), "s", "left_anti")
        asks, others = (_batch(_posts(x), sum(SHARES[:i]), sum(SHARES), width) for x in (still, sets))
        pairs = stored(_best(asks, others, k, threshold), "line-pairs")
        release(spark)
        checked = _verified(pairs, firsts, docs, threshold)
        # With less than k candidates, all of them failed: these keys are done.
        rest = checked.where(~F.col("like") & (F.col("n") >= k)).select("s")
        good = good.unionByName(checked.where("like").select("s"))
        failed = rest if failed is None else failed.unionByName(rest)
    # All keys together, from the first candidate on.
    afresh = F.lit(None).cast("struct<differ:int,e:bigint>").alias("after")
    k *= MORE
    asking = stored(failed.distinct().join(good, "s", "left_anti").select("s", afresh), "line-asking")
    while not asking.isEmpty():
        batches = max(1, -(-sum(SHARES) * asking.count() // (max(SHARES) * max(1, n_sets))))
        pairs = stored(_candidates(sets, asking, k, threshold, batches), "line-pairs")
        release(spark)
        checked = _verified(pairs, firsts, docs, threshold)
        good = good.unionByName(checked.where("like").select("s"))
        # Sets whose candidates all failed ask for the next ones, more at once.
        asking = stored(checked.where(~F.col("like") & (F.col("n") >= k)).select("s", "after"), "line-asking")
        k *= MORE
    # A set that resembles an earlier one goes whole; else all but its first line.
    ends = stored(
        numbered.join(good.withColumn("like", F.lit(True)), "s", "left").select("id", *SIGNS, "n", F.when(F.col("like").isNull(), F.col("first")).alias("first")),
        "line-ends",
    )
    discard(numbered)
    release(spark)
    out = (
        own.select("id", *SIGNS, "n", "doc_id", "row", "line_no").join(ends, ["id", *SIGNS, "n"])
        .where(F.col("first").isNull() | (F.col("first") < F.struct("doc_id", "line_no"))).select("doc_id", "row", "line_no")
    )
    out.read_from = (own, ends)
    return out


def removals(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document with removed lines: doc_id, row, removed (sorted numbers)."""
    gone = removed_lines(docs, threshold)
    out = stored(gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "line-removals")
    discard(*gone.read_from)
    release(docs.sparkSession)
    return out


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; all rows and
    columns stay, a text may become empty. Rows travel as one struct, so no column
    of theirs can clash with the stage's own."""
    gone = removals(docs, threshold).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "removed")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    # The explode of one element keeps the split text from being worked out
    # again for every kept line.
    split = whole.join(
        gone, F.col("whole.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.xxhash64("whole.text") == F.col("r")), "left"
    ).select("whole", "removed", F.explode(F.array(F.split("whole.text", "\n"))).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    text = F.when(F.col("removed").isNull(), F.col("whole.text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    )
    return split.select(*[text.alias("text") if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, removed_lines (numbers, joined by
    commas), from the removals; the text itself is not moved."""
    gone = removals(docs, threshold)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("row"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
    )
    return (
        own.alias("s")
        .join(gone.alias("g"), F.col("s.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("s.row") == F.col("g.row")), "left")
        .select(
            "s.doc_id",
            "n_lines",
            F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce(F.array_join(F.transform("removed", lambda x: x.cast("string")), ","), F.lit("")).alias("removed_lines"),
        )
    )
