"""Name search for a DataFrame of search texts, top ``limit`` per text.

A substring search of many texts against many names is a non-equi join; a
nested-loop join would pair every text with every name. Instead:

1. Each text is split at its wildcards (``%``, ``_``); its longest literal
   piece must occur in every matching name, so every gram of that piece
   does too. Of that piece's grams (length ``min(3, len(piece))``) the one
   held by the fewest names is the probe.
2. Names are dealt out evenly, once. Their grams (distinct per name) are counted
   where some text holds them, then joined with the texts on the probe gram - an
   equi-join, so each name meets only the texts that can match it. The grams of all
   names are never stored: a short list of texts is sent to the names, and a very
   common probe gram of a long list is a hot key, which AQE's skew join splits.
3. Candidates are verified with ILIKE, then the first ``limit`` per text by
   (name, LEI) are kept. The per-text ``row_number`` filter is planned with a
   partial window-group limit before the shuffle, so a text with a huge
   candidate set sends at most ``limit`` rows per task.

Texts without any literal character (e.g. ``''``, ``'__'``) match every name
of at least as many characters as they have ``_``; they are answered from
the ``limit`` first names of each name length: each text is paired with the
name lengths it accepts (the distinct lengths, bounded by the longest name,
are the broadcast side) and equi-joined on the length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ownergraph.functions.normalize import entity_projection
from ownergraph.operators.edges import restrict
from ownergraph.schema import DEFAULT_SEARCH_LIMIT, ENTITY_COLUMNS
from ownergraph.session import materialize, written
from ownergraph.sources.name_index import GRAM, NameIndex

MAX_GRAM = 3
# Stored index: posting lists intersected per text, and how many times longer than
# the text's shortest list a further one may be (a longer one costs more than it saves).
LISTS, LONGER = 3, 8


def _pattern(text_col: str) -> F.Column:
    # '%' + text + '%', a backslash kept as a plain character
    return F.concat(F.lit("%"), F.regexp_replace(F.col(text_col), r"\\", r"\\\\"), F.lit("%"))


def _grams(text: F.Column, g: F.Column) -> F.Column:
    """All substrings of length ``g`` of ``text`` (distinct)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - g + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, g)))


def _tagged_grams(text: F.Column, g: int) -> F.Column:
    return F.transform(_grams(text, F.lit(g)), lambda x: F.struct(F.lit(g).alias("g"), x.alias("gram")))


def search_by_name_batch(
    entities: DataFrame, searches: DataFrame, limit: int = DEFAULT_SEARCH_LIMIT, text_col: str = "query"
) -> DataFrame:
    """``(query, rank, <10 entity columns>)``: for each distinct search text,
    the first ``limit`` entities whose legal name contains it (ILIKE, case
    insensitive, wildcards live), ordered by name then LEI."""
    spark = entities.sparkSession
    texts = searches.select(F.col(text_col).alias("query")).where(F.col("query").isNotNull()).distinct()
    pieces = F.split(F.lower(F.col("query")), "[%_]")
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    texts = texts.select(
        "query",
        _pattern("query").alias("pattern"),
        longest["p"].alias("piece"),
        F.least(F.length(longest["p"]), F.lit(MAX_GRAM)).alias("g"),
        F.length(F.regexp_replace(F.col("query"), "[^_]", "")).alias("n_underscore"),
    )
    # Dealt out once: the table's files may be few, and each name becomes many grams.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = entities.select("lei", "legal_name").where(F.col("legal_name").isNotNull())
    names = written(names.repartition(parts), "name-search-names")

    # --- texts with a literal piece: gram postings -------------------------
    literal = texts.where(F.col("g") > 0)
    # Written: its size is known then, and the grams of a short list are sent to the names.
    text_grams = written(
        literal.select("query", "pattern", "g", F.explode(_grams(F.col("piece"), F.col("g"))).alias("gram")),
        "name-search-texts",
    )
    # One small job: gram lengths in use (at most 3 values), and whether there
    # are texts without a literal character.
    shapes = {r["g"] for r in texts.select("g").distinct().collect()}
    gram_sizes = sorted(shapes - {0})
    ranked_parts = []
    if gram_sizes:
        # Counted first (combined per task): only the grams that some text holds.
        wanted = text_grams.select(F.col("g").alias("__g"), F.col("gram").alias("__gram")).distinct()
        grams = F.flatten(F.array(*[_tagged_grams(F.lower(F.col("legal_name")), g) for g in gram_sizes]))
        exploded = names.select("lei", "legal_name", F.explode(grams).alias("x")).select("lei", "legal_name", "x.g", "x.gram")
        held = exploded.join(wanted, (F.col("g") == F.col("__g")) & (F.col("gram") == F.col("__gram")), "left_semi")
        freq = held.groupBy("g", "gram").agg(F.count(F.lit(1)).alias("df"))
        probe = written(
            text_grams.join(freq, ["g", "gram"], "left")
            .groupBy("query", "pattern", "g")
            .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("gram"))).alias("probe"))
            .where("probe.df > 0")
            .select("query", "pattern", "g", F.col("probe.gram").alias("gram")),
            "name-search-probes",
        )
        candidates = exploded.join(probe, ["g", "gram"]).where(F.expr("legal_name ILIKE pattern"))
        ranked_parts.append(candidates.select("query", "lei", "legal_name"))

    # --- texts without a literal character: top names per name length ------
    if 0 in shapes or not shapes:
        wild = texts.where(F.col("g") == 0)
        by_len = Window.partitionBy("len").orderBy("legal_name", "lei")
        per_len = (
            names.withColumn("len", F.length("legal_name"))
            .withColumn("__r", F.row_number().over(by_len))
            .where(F.col("__r") <= limit)
            .drop("__r")
        )
        # texts x name lengths is small: lengths are bounded by the longest name
        lengths = per_len.select("len").distinct()
        wild_lens = wild.join(F.broadcast(lengths), F.col("len") >= F.col("n_underscore"))
        ranked_parts.append(wild_lens.join(per_len, "len").select("query", "lei", "legal_name"))

    hits = ranked_parts[0]
    for p in ranked_parts[1:]:
        hits = hits.unionByName(p)
    order = Window.partitionBy("query").orderBy(F.col("legal_name").asc(), F.col("lei").asc())
    # Written: its size is known then, and a short answer is sent to the entities.
    top = written(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "rank", "lei"), "name-search-top")
    ent = entities.select(*ENTITY_COLUMNS).alias("e")
    out = top.join(ent, top["lei"] == F.col("e.lei")).select(
        "query", F.col("rank").cast("int").alias("rank"), *entity_projection("e")
    )
    return out


def search_by_name_stored(
    entities: DataFrame,
    index: NameIndex,
    searches: DataFrame,
    limit: int | None = DEFAULT_SEARCH_LIMIT,
    text_col: str = "query",
) -> DataFrame:
    """``search_by_name_batch`` over the stored index: the same rows (``limit`` None =
    all matches), without a scan of the names.

    Every gram of every literal piece of a text occurs in a matching name; a text
    without a piece of three characters is looked up by its longest piece, as the
    beginning of grams. The dictionary tells how many names each of these parts has;
    the posting lists of the rarest are read (only their buckets) and intersected per
    text and LEI, combined per task. The entities left are read by their own buckets
    and verified with ILIKE. Texts without a literal character ask for nearly all
    names and go to ``search_by_name_batch``.
    """
    texts = searches.select(F.col(text_col).alias("query")).where(F.col("query").isNotNull()).distinct()
    pieces = F.split(F.lower(F.col("query")), "[%_]")
    starts = lambda p: F.sequence(F.lit(1), F.length(p) - (GRAM - 1))
    whole = F.flatten(
        F.transform(
            F.filter(pieces, lambda p: F.length(p) >= GRAM),
            lambda p: F.transform(starts(p), lambda i: F.substring(p, i, F.lit(GRAM))),
        )
    )
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    cut = texts.select("query", whole.alias("whole"), longest["p"].alias("longest"))
    parts = cut.select(
        "query",
        F.explode(F.when(F.size("whole") > 0, F.array_distinct("whole")).otherwise(F.array("longest"))).alias("part"),
    )
    literal, wild = parts.where("part <> ''"), parts.where("part = ''")

    # --- the rarest parts of each text, with their grams --------------------
    beginnings = F.array_distinct(F.array(*[F.substring("gram", 1, n) for n in range(1, GRAM + 1)]))
    listed = index.counts.select(F.explode(beginnings).alias("part"), "gram", "names")
    found = materialize(literal.join(listed, "part", "left"))
    weight = found.groupBy("query", "part").agg(F.coalesce(F.sum("names"), F.lit(0)).alias("w"))
    rarest = Window.partitionBy("query").orderBy("w", "part")
    chosen = (
        weight.withColumn("k", F.row_number().over(rarest))
        .withColumn("least", F.min("w").over(rarest))
        .where((F.col("k") <= LISTS) & (F.col("w") <= F.col("least") * LONGER))
        .select("query", "part", "k")
    )
    wanted = found.join(chosen, ["query", "part"]).select("query", "k", "gram")
    # Bits of the chosen parts; a part that no name has leaves its text without rows.
    all_of = chosen.groupBy("query").agg(F.sum(F.expr("shiftleft(1L, k - 1)")).alias("all_of"))
    wanted = written(wanted.join(all_of, "query"), "name-search-grams")

    # --- posting lists, intersected ------------------------------------------
    asked = wanted.where("gram IS NOT NULL").select(F.col("gram").alias("lei"))
    lists = restrict(index.postings, "gram", asked).select("gram", "lei")
    candidates = written(
        lists.join(wanted, "gram")
        .groupBy("query", "lei", "all_of")
        .agg(F.bit_or(F.expr("shiftleft(1L, k - 1)")).alias("bits"))
        .where("bits = all_of")
        .select("query", F.col("lei").alias("__lei")),
        "name-search-candidates",
    )
    near = restrict(entities, "lei", candidates.select(F.col("__lei").alias("lei"))).select(*ENTITY_COLUMNS)
    hits = (
        near.join(candidates, F.col("lei") == F.col("__lei"))
        .withColumn("pattern", _pattern("query"))
        .where(F.expr("legal_name ILIKE pattern"))
    )
    order = Window.partitionBy("query").orderBy(F.col("legal_name").asc(), F.col("lei").asc())
    top = hits.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        top = top.where(F.col("rank") <= limit)
    out = top.select("query", F.col("rank").cast("int").alias("rank"), *entity_projection())
    asked_wild = wild.select("query")
    if not asked_wild.isEmpty():
        most = limit if limit is not None else 2**31 - 1
        out = out.unionByName(search_by_name_batch(entities, asked_wild, most))
    return out
