"""Lexical retrieval over document tables.

Documents: document_id, part, ord, source_type, title, text, metadata MAP<STRING,STRING>, upload_session_id. A
document whose metadata grows with the data (the list of known values) is spread over several ``part`` rows;
part 0 carries title and text. Lists inside metadata are joined by spaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.functions import text as x
from tallgrid.operators import matching, queries
from tallgrid.session import LOOKUP_ROWS, cut

DOC_SCHEMA = ("document_id string, part int, ord long, source_type string, title string, text string, "
              "metadata map<string,string>, upload_session_id string")
DOC_COLUMNS = ("document_id", "part", "ord", "source_type", "title", "text", "metadata", "upload_session_id")


def _fixed_docs() -> list[tuple]:
    join = ", ".join
    words = " ".join
    docs = [
        ("schema:overview", "schema_doc", "What the observations hold",
         "Every observation has a measure, its dimensions, a value in the measure's own unit, a status and flags. "
         "Queries read observations and never change them.",
         {"canonical_date_field": catalog.DATE_FIELD, "canonical_dimensions": words(catalog.DIMENSIONS),
          "canonical_measures": words(catalog.MEASURES)}),
        ("validation:overview", "validation_doc", "How observations are judged",
         " ".join(f"{s}: {t}" for s, t in catalog.STATUS_TEXT.items())
         + f" Flags that make an observation invalid: {join(sorted(catalog.BLOCKING_FLAGS))}. Expected values: "
         + join(f"{m}:{low}..{high}" for m, (low, high) in catalog.OUTLIER_RANGES.items()) + ".",
         {"validation_statuses": words(catalog.STATUSES), "invalid_flags": words(sorted(catalog.BLOCKING_FLAGS)),
          "outlier_ranges": words(f"{m}:{low}-{high}" for m, (low, high) in catalog.OUTLIER_RANGES.items())}),
    ]
    for d in catalog.DIMENSIONS:
        docs.append((f"canonical:dimension:{d}", "canonical_catalog", f"Dimension {d}",
                     f"{catalog.DIMENSION_TEXT[d]} Found by the words {join(catalog.DIMENSION_TOKENS[d])}.",
                     {"canonical_dimension": d, "token_examples": words(catalog.DIMENSION_TOKENS[d])}))
    for m in catalog.MEASURES:
        accepted = [u for mm, u, _ in catalog.UNIT_FACTORS if mm == m]
        docs.append((f"canonical:measure:{m}", "canonical_catalog", f"Measure {m}",
                     f"{catalog.MEASURE_TEXT[m]} Found by the words {join(catalog.MEASURE_TOKENS[m])}.",
                     {"canonical_measure": m, "token_examples": words(catalog.MEASURE_TOKENS[m])}))
        docs.append((f"units:{m}", "unit_doc", f"Units of {m}",
                     f"Values of {m} may come in {join(accepted)}; they are stored in {catalog.CANONICAL_UNIT[m]}.",
                     {"canonical_measure": m, "supported_units": words(accepted),
                      "canonical_unit": catalog.CANONICAL_UNIT[m]}))
    for f, text in catalog.FLAG_TEXT.items():
        docs.append((f"validation:flag:{f}", "validation_doc", f"Flag {f}", text,
                     {"quality_flag": f, "blocking": str(f in catalog.BLOCKING_FLAGS)}))
    return docs


AVAILABLE = {"variable": "available_variables", "normalized_unit": "available_normalized_units",
             "variety": "available_varieties", "location": "available_locations",
             "treatment": "available_treatments", "plot_id": "available_plot_ids"}


def schema_docs(spark: SparkSession, obs: DataFrame) -> DataFrame:
    """R1. Known values become one metadata part each, so nothing is collected into one row."""
    fixed = _fixed_docs()
    rows = [(i, 0, (o if o == 0 else o + 1), *rest, None) for o, (i, *rest) in enumerate(fixed)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    values = cut(queries.distinct_values(obs, tuple(AVAILABLE)))  # two documents are made of them, observations are read once
    listing = lambda field: F.array_join(F.array_sort(F.collect_set(F.when(F.col("field") == field, F.col("value")))),
                                         ", ")
    supported = {"supported_filters": catalog.LIST_FILTERS, "supported_group_bys": catalog.LIST_GROUPS,
                 "supported_metrics": catalog.LIST_METRICS}
    some = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("none"))
    # measures and their units only: a list as long as the catalogue of variables
    main = values.filter(F.col("field").isin("variable", "normalized_unit")).agg(
        listing("variable").alias("variables"), listing("normalized_unit").alias("units")).select(
        F.lit("query:metadata").alias("document_id"), F.lit(0).alias("part"), F.lit(1).cast("long").alias("ord"),
        F.lit("query_metadata").alias("source_type"), F.lit("What can be asked").alias("title"),
        F.concat(F.lit("Filters: " + ", ".join(catalog.LIST_FILTERS) + ". Groupings: "
                       + ", ".join(catalog.LIST_GROUPS) + ". Metrics: " + ", ".join(catalog.LIST_METRICS)
                       + ". Variables in the data: "), some(F.col("variables")),
                 F.lit(". Units in the data: "), some(F.col("units")), F.lit(".")).alias("text"),
        F.create_map(*[F.lit(t) for k, names in supported.items() for t in (k, " ".join(names))]).alias("metadata"),
        F.lit(None).cast("string").alias("upload_session_id"))
    label = F.create_map(*[F.lit(t) for pair in AVAILABLE.items() for t in pair])
    parts = values.select(
        F.lit("query:metadata").alias("document_id"), F.lit(1).alias("part"), F.lit(1).cast("long").alias("ord"),
        F.lit("query_metadata").alias("source_type"), F.lit("What can be asked").alias("title"),
        F.lit("").alias("text"), F.create_map(label[F.col("field")], F.col("value")).alias("metadata"),
        F.lit(None).cast("string").alias("upload_session_id"))
    return reduce(DataFrame.unionByName, [docs, main, parts])


def _doc(df: DataFrame, kind: int, position: Column, source_type: str, document_id: Column, title: Column,
         text: Column, metadata: dict[str, Column]) -> DataFrame:
    entries = [e for k, c in metadata.items() for e in (F.lit(k), F.coalesce(c.cast("string"), F.lit("None")))]
    return df.select(
        document_id.alias("document_id"), F.lit(0).alias("part"),
        (F.lit(kind * 10**9) + position).cast("long").alias("ord"), F.lit(source_type).alias("source_type"),
        title.alias("title"), text.alias("text"), F.create_map(*entries).alias("metadata"), "upload_session_id")


def _fmt(template: str, *columns: Column) -> Column:
    pieces = template.split("{}")
    out = [F.lit(pieces[0])]
    for column, piece in zip(columns, pieces[1:]):
        out += [F.coalesce(column.cast("string"), F.lit("None")), F.lit(piece)]
    return F.concat(*out)


def artifact_docs(artifacts: DataFrame) -> DataFrame:
    """R2."""
    c = F.col
    return _doc(artifacts, 1, F.lit(0), "raw_artifact", _fmt("upload:{}:artifact", c("upload_session_id")),
                _fmt("File of upload {}", c("upload_session_id")),
                _fmt("The file {} was read by parser {} as {}; it has {} bytes and the checksum {}.", c("original_filename"), c("parser_version"), c("mime_type"), c("file_size_bytes"),
                     c("file_hash_sha256")),
                {n: c(n) for n in ("upload_session_id", "original_filename", "parser_version", "mime_type",
                                   "file_size_bytes", "file_hash_sha256")})


def sheet_docs(sheets: DataFrame) -> DataFrame:
    """R2."""
    c = F.col
    return _doc(sheets, 2, c("sheet_index"), "sheet_manifest",
                _fmt("upload:{}:sheet:{}", c("upload_session_id"), c("sheet_name")),
                _fmt("Extent of sheet {}", c("sheet_name")),
                _fmt("On sheet {} there are {} rows of up to {} columns, {} filled cells and {} tables.",
                     c("sheet_name"), c("row_count"), c("max_column_count"), c("non_empty_cell_count"),
                     c("detected_block_count")),
                {n: c(n) for n in ("upload_session_id", "sheet_name", "sheet_index", "row_count", "max_column_count",
                                   "non_empty_cell_count", "detected_block_count")})


def warning_docs(warnings: DataFrame) -> DataFrame:
    """R2: (upload_session_id, sheet_index, warning); numbered per upload (as many as the upload has sheets)."""
    c = F.col
    numbered = warnings.withColumn("n", F.row_number().over(
        Window.partitionBy("upload_session_id").orderBy("sheet_index")))
    return _doc(numbered, 3, c("n"), "parse_warning", _fmt("upload:{}:warning:{}", c("upload_session_id"), c("n")),
                _fmt("Doubt {} about upload {}", c("n"), c("upload_session_id")),
                _fmt("Reading it gave: {}.", c("warning")),
                {n: c(n) for n in ("upload_session_id", "warning")})


def block_docs(blocks: DataFrame, columns: DataFrame) -> DataFrame:
    """R2: blocks (upload_session_id, block_id, sheet_name, range, block_no) with their column mapping."""
    c = F.col
    key = ["upload_session_id", "block_id"]
    listed = columns.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_pos", "column"))), lambda s: s["column"]).alias("heads"),
        F.array_sort(F.collect_set("canonical_measure")).alias("measures"),
        F.array_sort(F.collect_set("canonical_dimension")).alias("dims"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("codes"))
    joined = blocks.join(listed, key, "left")
    shown = lambda name, empty: F.coalesce(F.nullif(F.array_join(name, ", "), F.lit("")), F.lit(empty))
    spaced = lambda name: F.coalesce(F.array_join(name, " "), F.lit(""))
    return _doc(joined, 4, c("block_no"), "preview_block", _fmt("upload:{}:block:{}", c(key[0]), c("block_id")),
                _fmt("Table {} of {}", c("block_id"), c("sheet_name")),
                _fmt("Table {} of sheet {} lies at {}. Its columns: {}. Measures: {}. Dimensions: {}. Doubts: {}.", c("block_id"), c("sheet_name"), c("range"),
                     shown("heads", "n/a"), shown("measures", "none"), shown("dims", "none"), shown("codes", "none")),
                {"upload_session_id": c(key[0]), "block_id": c("block_id"), "sheet": c("sheet_name"),
                 "range": c("range"), "headers": spaced("heads"), "canonical_measures": spaced("measures"),
                 "canonical_dimensions": spaced("dims"), "warning_codes": spaced("codes")})


def load_corpus(schema: DataFrame | None, raw: DataFrame | None, upload_session_id: str | None,
                include_schema: bool = True, include_raw: bool = True) -> DataFrame:
    """Schema documents and / or the documents of one upload."""
    chosen = []
    if include_schema and schema is not None:
        chosen.append(schema.select(*DOC_COLUMNS))
    if include_raw and raw is not None and upload_session_id:
        chosen.append(raw.filter(F.col("upload_session_id") == upload_session_id).select(*DOC_COLUMNS))
    if not chosen:
        raise ValueError("nothing to load")
    return reduce(DataFrame.unionByName, chosen)


PHRASE, PROBES = 25, 10  # points of a whole query found; documents probed for each wanted one


def fold_docs(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", x.fold_document(F.col("title")).alias("_title"),
                       x.fold_document(F.col("text")).alias("_body"),
                       x.fold_document(x.metadata_text(F.col("metadata"))).alias("_meta"))


def opened_words(texts: DataFrame) -> DataFrame:
    """(document_id, word, weight) of folded texts: 5 title, 2 body, 1 metadata; words are distinct inside a field."""
    words = lambda c, weight: F.transform(F.array_distinct(F.split(c, " ")), lambda w: F.struct(
        w.alias("word"), F.lit(weight).alias("weight")))
    fields = F.concat(words(F.col("_title"), 5), words(F.col("_body"), 2), words(F.col("_meta"), 1))
    return texts.select("document_id", F.explode(fields).alias("p")).select("document_id", "p.*")


def postings(docs: DataFrame) -> DataFrame:
    """(document_id, word, weight) of documents."""
    return opened_words(fold_docs(docs))


def _best_points() -> Column:
    """The points of a token in a document: each field that holds it counts once."""
    best = lambda w: F.max(F.when(F.col("weight") == w, w).otherwise(0))
    return (best(5) + best(2) + best(1)).alias("points")


def _hits_by_words(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(document_id, token, points): tokens are matched against the distinct vocabulary and reach documents through the postings."""
    index = cut(postings(docs))  # read for the vocabulary and for the postings
    matches = matching.contained(index.select("word").distinct(), "word", tokens, "token").select("word", "token")
    return index.join(matches, "word").groupBy("document_id", "token").agg(_best_points())


def _hits_in_place(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """The same from folded texts that stay where they are, for tokens that every task can hold."""
    return matching.contained_in_place(opened_words(texts), "word", tokens, "token").groupBy("document_id", "token").agg(_best_points())


PAIRS = 1 << 18  # pairs of a query and a document whose points one task adds up in memory


def score(queries_df: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, document_id, score) for every positive score, queries given as (query_id, query).

    Only documents that hold every token of a query can hold the whole query, so the phrase test reads those candidates only.
    Where the tokens asked for fit into every task, texts are dealt by document once and neither words nor pairs move after
    that. Otherwise tokens meet the vocabulary: a token has no blanks, so it occurs in a text exactly when it occurs in one of
    the text's words.
    """
    c = F.col
    folded = queries_df.select("query_id", x.fold_document(c("query")).alias("_query"))
    asked = cut(folded.select("query_id", F.explode(x.tokens(c("_query"))).alias("token")))
    need = folded.select("query_id", "_query", F.size(x.tokens(c("_query"))).alias("needed"))
    tokens, texts = asked.select("token").distinct(), fold_docs(docs)
    if asked.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        pairs = docs.count() * asked.select("query_id").distinct().count()
        tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
        texts = texts.repartition(tasks, "document_id")
        hits, asked = _hits_in_place(texts, tokens), F.broadcast(asked)
    else:
        hits = _hits_by_words(docs, tokens)
    known = hits.join(asked, "token").groupBy("query_id", "document_id").agg(
        F.sum("points").alias("points"), F.count(F.lit(1)).alias("matched")).join(need, "query_id")
    # a query of one word is found wherever its token is; only longer ones are looked up in the texts
    single = ~c("_query").contains(" ")
    marked = known.select("query_id", "document_id", "points", single.alias("_single"), F.when(
        (c("matched") == c("needed")) & ~single, c("_query")).alias("_phrase"))
    whole = F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in ("_title", "_body", "_meta")])
    held = texts.select(c("document_id").alias("_id"), whole.alias("_whole")).hint("shuffle_hash")
    met = marked.join(held, (c("document_id") == c("_id")) & c("_phrase").isNotNull() & c("_whole").contains(c("_phrase")), "left")
    found = F.when(c("_single") | c("_id").isNotNull(), PHRASE).otherwise(0)
    return met.groupBy("query_id", "document_id").agg(  # a document may hold the query in several parts
        (F.first("points") + F.max(found)).cast("double").alias("score"))


def top_k(scores: DataFrame, docs: DataFrame, k: int = catalog.CONTEXT_LIMIT_MAX) -> DataFrame:
    """(query_id, rank, document_id, score). Ranking keeps k rows per query and task before the shuffle."""
    heads = docs.filter(F.col("part") == 0).select("document_id", "source_type", "title")
    catalog.check_limit(k, catalog.CONTEXT_LIMIT_MAX)
    order = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), "source_type", F.lower("title"), "document_id")
    ranked = scores.join(heads, "document_id").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select(
        "query_id", "rank", "document_id", "source_type", "title", "score")


def _token_stats(words: DataFrame, matches: DataFrame) -> DataFrame:
    """Per token the most points that any document can get for it, and a bound on the number of documents that hold it."""
    has = lambda w: F.max(F.col(f"_{w}")) * w
    return matches.join(words, "word").groupBy("token").agg(
        (has(5) + has(2) + has(1)).alias("top"), F.sum("docs").alias("spread"))


def thresholds(asked: DataFrame, index: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """(query_id, bar): the k-th best score, without phrases, among the ``PROBES`` k documents of most words."""
    widest = index.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "document_id").limit(PROBES * k)
    best = lambda w: F.max(F.when(F.col("weight") == w, w).otherwise(0))
    hits = (index.join(widest.select("document_id"), "document_id", "left_semi").join(matches, "word")
            .groupBy("document_id", "token").agg((best(5) + best(2) + best(1)).alias("points")))
    known = hits.join(asked, "token").groupBy("query_id", "document_id").agg(F.sum("points").alias("points"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("points")))
    return known.withColumn("_place", place).filter(F.col("_place") == k).select("query_id", F.col("points").alias("bar"))


def candidates(queries_df: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, document_id, sure, _query, _tokens, _rest): the pairs that can still be among a query's k best.

    Postings are opened from the rarest token on. The tokens whose best points in sum stay below the bar of the query, the most
    frequent ones first, are never opened: a document that holds none of the others cannot reach the bar. What is found
    in the opened lists (``sure``) plus the best points of the rest (``_rest``, still to be looked up) is a pair's upper bound.
    """
    folded = queries_df.select("query_id", x.fold_document(F.col("query")).alias("_query"))
    asked = cut(folded.select("query_id", F.explode(x.tokens(F.col("_query"))).alias("token")))
    index = cut(postings(docs))  # read for the vocabulary, the probes and the opened lists
    words = index.groupBy("word").agg(F.count(F.lit(1)).alias("docs"), *[
        F.max((F.col("weight") == w).cast("int")).alias(f"_{w}") for w in (5, 2, 1)])
    words = cut(words)
    matches = cut(matching.contained(words.select("word"), "word", asked.select("token").distinct(), "token")
                  .select("word", "token"))
    stats = _token_stats(words, matches)
    common = Window.partitionBy("query_id").orderBy(F.desc("spread"), "token")
    bars = thresholds(asked, index, matches, k)
    ranked = asked.join(stats, "token").join(bars, "query_id", "left").withColumn(
        "_below", F.sum("top").over(common.rowsBetween(Window.unboundedPreceding, 0)))
    opened = F.col("_below") >= F.coalesce("bar", F.lit(0))
    lists = cut(ranked.withColumn("opened", opened))
    need = lists.groupBy("query_id").agg(
        F.coalesce(F.first("bar"), F.lit(0)).alias("bar"), F.count_if("opened").alias("n_opened"),
        F.sum(F.when(F.col("opened"), 0).otherwise(F.col("top"))).alias("best_rest"),
        F.collect_list(F.when(~F.col("opened"), F.col("token"))).alias("_rest"))
    best = lambda w: F.max(F.when(F.col("weight") == w, w).otherwise(0))
    wanted = lists.filter("opened").select("query_id", "token")
    hits = (index.join(matches.join(wanted.select("token").distinct(), "token", "left_semi"), "word")
            .groupBy("document_id", "token").agg((best(5) + best(2) + best(1)).alias("points")))
    found = hits.join(wanted, "token").groupBy("query_id", "document_id").agg(
        F.sum("points").alias("sure"), F.count(F.lit(1)).alias("n_found"))
    sizes = folded.select("query_id", "_query", F.size(x.tokens(F.col("_query"))).alias("n_tokens"))
    reach = F.col("sure") + F.col("best_rest") + F.when(F.col("n_found") == F.col("n_opened"), PHRASE).otherwise(0)
    return found.join(need, "query_id").filter(reach >= F.col("bar")).join(sizes, "query_id").select(
        "query_id", "document_id", "sure", "n_found", "n_tokens", "_query", "_rest")


def ranked(queries_df: DataFrame, docs: DataFrame, k: int = catalog.CONTEXT_LIMIT_MAX) -> DataFrame:
    """R3 and R4 together, (query_id, rank, document_id, source_type, title, score), without scoring all pairs.

    The rows are those of ``top_k(score(...))``. Only the pairs that ``candidates`` leaves meet the texts, where the frequent
    tokens and the phrase are looked up.
    """
    catalog.check_limit(k, catalog.CONTEXT_LIMIT_MAX)
    return top_k(looked_up(candidates(queries_df, docs, k), docs), docs, k)


def looked_up(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, document_id, score) of given pairs: ``sure`` points of ``n_found`` tokens are known, the tokens ``_rest`` and the
    phrase ``_query`` are looked up in the texts."""
    c = F.col
    texts = docs.select("document_id", x.fold_document(c("title")).alias("_title"), x.fold_document(c("text")).alias("_body"),
                        x.fold_document(x.metadata_text(c("metadata"))).alias("_meta"))
    held = lambda field: F.filter("_rest", lambda t: c(field).contains(t))
    whole = F.concat_ws(" ", *[F.nullif(c(f), F.lit("")) for f in ("_title", "_body", "_meta")])
    looked = pairs.join(texts, "document_id").select(
        "query_id", "document_id", "sure", "n_found", "n_tokens", *[held(f).alias(f) for f in ("_title", "_body", "_meta")],
        whole.contains(c("_query")).alias("_phrase"))
    together = lambda name: F.array_distinct(F.flatten(F.collect_list(name)))
    summed = looked.groupBy("query_id", "document_id").agg(
        F.first("sure").alias("sure"), F.first("n_found").alias("n_found"), F.first("n_tokens").alias("n_tokens"),
        F.bool_or("_phrase").alias("_phrase"), *[together(f).alias(f) for f in ("_title", "_body", "_meta")])
    n_held = c("n_found") + F.size(F.array_distinct(F.concat("_title", "_body", "_meta")))
    points = c("sure") + 5 * F.size("_title") + 2 * F.size("_body") + F.size("_meta")
    bonus = F.when(c("_phrase") & (n_held == c("n_tokens")), PHRASE).otherwise(0)
    return summed.select("query_id", "document_id", (points + bonus).cast("double").alias("score"))


def attach_snippet(hits: DataFrame, docs: DataFrame, queries_df: DataFrame | None = None) -> DataFrame:
    """Snippets around the first token of the query, or the first 220 characters without a query."""
    texts = docs.filter(F.col("part") == 0).select("document_id", "text")
    joined = hits.join(texts, "document_id")
    if queries_df is None:
        return joined.withColumn("snippet", F.substring("text", 1, x.SNIPPET)).drop("text")
    tokens = queries_df.select("query_id", x.tokens(x.fold_document(F.col("query"))).alias("_tokens"))
    return (joined.join(tokens, "query_id")
            .withColumn("snippet", x.snippet(F.col("text"), F.col("_tokens"))).drop("text", "_tokens"))


def search(queries_df: DataFrame, docs: DataFrame, k: int = catalog.CONTEXT_LIMIT_MAX) -> DataFrame:
    """R3-R5 together."""
    return attach_snippet(ranked(queries_df, docs, k), docs, queries_df)


def explain_metadata(schema: DataFrame, topics: DataFrame, k: int = 5) -> DataFrame:
    """The search restricted to schema documents; topics as (query_id, query)."""
    return search(topics, schema, k)


FIXED_DOCS = ("schema:overview", "query:metadata", "validation:overview")
RAW_STAGES = {"raw_artifact": 3, "preview_block": 4, "sheet_manifest": 5, "parse_warning": 6}


def _scope_hits(docs: DataFrame, scopes: DataFrame, text: str, stage: int) -> DataFrame:
    """The best ``limit`` documents of each scope for a text of it. Documents on the schema, which all scopes share, go through
    the index; those of an upload meet the scopes that ask for it."""
    c = F.col
    asked = scopes.filter(F.coalesce(text, F.lit("")) != "").select(
        c("scope_id").alias("query_id"), c(text).alias("query"), "upload_session_id", "limit")
    shared = score(asked.select("query_id", "query"), docs.filter(c("upload_session_id").isNull()))
    folded = x.fold_document(c("query"))
    raw = docs.filter(c("upload_session_id").isNotNull())
    pairs = asked.select("query_id", "upload_session_id", folded.alias("_query"), x.tokens(folded).alias("_rest")).join(
        raw.select("document_id", "upload_session_id").distinct(), "upload_session_id").select(
        "query_id", "document_id", F.lit(0).alias("sure"), F.lit(0).alias("n_found"), F.size("_rest").alias("n_tokens"),
        "_query", "_rest")
    found = shared.unionByName(looked_up(pairs, raw).filter("score > 0"))
    return top_k(found, docs).join(asked.select("query_id", "limit"), "query_id").filter(c("rank") <= c("limit")).select(
        c("query_id").alias("scope_id"), "document_id", F.lit(stage).alias("stage"), c("rank").cast("long").alias("ord"))


def select_contexts(docs: DataFrame, scopes: DataFrame, include_schema: bool = True, include_raw: bool = True) -> DataFrame:
    """R6 for a table of scopes: (scope_id, place, stage, ord, document columns), the first ``limit`` documents of each scope.

    ``scopes``: scope_id, upload_session_id, variable, question, limit. ``docs`` holds the documents on the schema and those of
    all uploads; a scope sees the former and those of its own upload. Stages fill a scope in turn: the overviews, the
    documents of its measure, its upload by kind, hits of its question, hits of its variable. The first occurrence counts.
    A scope that no stage fills gets its documents in their order.
    """
    c = F.col
    schema, own = c("upload_session_id").isNull(), ["scope_id", "variable", "upload_session_id"]
    asked = docs.join(scopes.select("upload_session_id").distinct(), "upload_session_id", "left_semi")
    docs = cut(docs.filter(schema).select(*DOC_COLUMNS).unionByName(asked.select(*DOC_COLUMNS)))
    heads = docs.filter(c("part") == 0)
    named = lambda ids: scopes.select("scope_id", "variable", F.explode(F.array(*ids)).alias("document_id"))
    stage = lambda df, number: df.select("scope_id", "document_id", F.lit(number).alias("stage"), "ord")
    parts, shared = [], heads.filter(schema)
    if include_schema:
        parts.append(stage(named([F.lit(i) for i in FIXED_DOCS]).join(heads, "document_id"), 1))
        about = named([F.concat(F.lit(kind), "variable") for kind in ("canonical:measure:", "units:")])
        parts.append(stage(about.filter(c("document_id").isNotNull()).join(shared, "document_id"), 2))
        parts.append(stage(scopes.select("scope_id", "variable").join(
            shared.withColumn("variable", c("metadata")["canonical_measure"]), "variable"), 2))
    if include_raw:
        number = F.coalesce(*[F.when(c("source_type") == kind, n) for kind, n in RAW_STAGES.items()])
        listed = c("variable").isNull() | F.coalesce(F.array_contains(
            F.split(c("metadata")["canonical_measures"], " "), c("variable")), F.lit(False))
        mine = scopes.select(*own).join(heads, "upload_session_id").withColumn("stage", number).filter(
            c("stage").isNotNull() & ((c("source_type") != "preview_block") | listed))
        parts.append(mine.select("scope_id", "document_id", "stage", "ord"))
    parts += [_scope_hits(docs, scopes, "question", 7), _scope_hits(docs, scopes, "variable", 8)]
    first = cut(reduce(DataFrame.unionByName, parts).groupBy("scope_id", "document_id").agg(
        F.min(F.struct("stage", "ord")).alias("at")))
    bare = scopes.join(first.select("scope_id"), "scope_id", "left_anti").select("scope_id", "upload_session_id")
    every = bare.join(heads, "upload_session_id").select("scope_id", "document_id", "ord").unionByName(
        bare.withColumn("_all", F.lit(1)).join(shared.withColumn("_all", F.lit(1)).drop("upload_session_id"), "_all")
        .select("scope_id", "document_id", "ord"))
    filled = first.unionByName(every.select("scope_id", "document_id", F.struct(F.lit(9).alias("stage"), "ord").alias("at")))
    place = F.row_number().over(Window.partitionBy("scope_id").orderBy("at", "document_id"))
    chosen = filled.withColumn("place", place).filter(c("place") <= catalog.CONTEXT_LIMIT_MAX).join(
        scopes.select("scope_id", "limit"), "scope_id").filter(c("place") <= c("limit"))
    return chosen.join(heads.drop("ord"), "document_id").select(
        "scope_id", "place", c("at.stage").alias("stage"), c("at.ord").alias("ord"), *[n for n in DOC_COLUMNS if n != "ord"])


def select_context(docs: DataFrame, variable: str | None = None, question: str | None = None,
                   include_schema: bool = True, include_raw: bool = True, limit: int = 10) -> DataFrame:
    """R6 for one scope: ``docs`` are its documents, of whatever upload."""
    catalog.check_limit(limit, catalog.CONTEXT_LIMIT_MAX)
    one = docs.sparkSession.createDataFrame([("scope", "own", variable, question, limit)],
                                            "scope_id string, upload_session_id string, variable string, question string, limit int")
    uploads = docs.filter("part = 0").select("document_id", "upload_session_id")
    alone = docs.withColumn("upload_session_id", F.when(F.col("upload_session_id").isNotNull(), "own"))
    chosen = select_contexts(alone, one, include_schema, include_raw)
    return chosen.drop("scope_id", "place", "upload_session_id").join(uploads, "document_id")


def source_summary(docs: DataFrame) -> DataFrame:
    """R7."""
    return (docs.filter(F.col("part") == 0).groupBy("source_type", "upload_session_id")
            .agg(F.count(F.lit(1)).alias("document_count")))


def context_sections(selected: DataFrame, variable: str | None = None, question: str | None = None) -> DataFrame:
    """Scope, schema and raw sections with document ids; ``selected`` is a limited context selection."""
    c = F.col
    ids = F.transform(F.array_sort(F.collect_list(F.struct("stage", "ord", "document_id"))),
                      lambda d: d["document_id"])
    schema = c("upload_session_id").isNull()
    grouped = selected.groupBy(schema.alias("is_schema")).agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))
    sections = grouped.select(
        F.when(c("is_schema"), 2).otherwise(3).alias("section_no"),
        F.when(c("is_schema"), "About the data model").otherwise("About the files").alias("title"),
        F.when(c("is_schema"), _fmt("{} documents describe the model.", c("n")))
        .otherwise(_fmt("{} documents describe uploads.", c("n"))).alias("body"),
        c("ids").alias("source_document_ids"))
    scope = [p for p in (f"variable={variable}" if variable else None,
                         f"question={question}" if question else None) if p]
    if scope:
        head = selected.sparkSession.createDataFrame(
            [(1, "Asked for", "Chosen by " + ", ".join(scope) + ".", [])],
            "section_no int, title string, body string, source_document_ids array<string>")
        sections = head.unionByName(sections)
    return sections


def context_summary(selected: DataFrame, variable: str | None = None,
                    upload_session_id: str | None = None) -> DataFrame:
    """One sentence on what was selected."""
    scope = [p for p in (f"variable={variable}" if variable else None,
                         f"upload_session_id={upload_session_id}" if upload_session_id else None) if p]
    suffix = " for " + ", ".join(scope) if scope else ""
    types = F.array_join(F.array_sort(F.collect_set("source_type")), ", ")
    return selected.agg(F.concat(
        F.lit("Found "), F.count(F.lit(1)).cast("string"), F.lit(f" documents{suffix}; their kinds: "),
        F.coalesce(F.nullif(types, F.lit("")), F.lit("none")), F.lit(".")).alias("summary"))


def _scope_text(*names: str) -> Column:
    """``name=value`` of the columns of a scope that are set."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), F.col(n)) for n in names])


def scope_sections(selected: DataFrame, scopes: DataFrame) -> DataFrame:
    """R8 for ``select_contexts``: (scope_id, section_no, title, body, source_document_ids)."""
    c = F.col
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "document_id"))), lambda d: d["document_id"])
    grouped = selected.groupBy("scope_id", c("upload_session_id").isNull().alias("is_schema")).agg(
        F.count(F.lit(1)).alias("n"), ids.alias("ids"))
    sections = grouped.select(
        "scope_id", F.when(c("is_schema"), 2).otherwise(3).alias("section_no"),
        F.when(c("is_schema"), "About the data model").otherwise("About the files").alias("title"),
        F.when(c("is_schema"), _fmt("{} documents describe the model.", c("n")))
        .otherwise(_fmt("{} documents describe uploads.", c("n"))).alias("body"), c("ids").alias("source_document_ids"))
    asked = _scope_text("variable", "question")
    heads = scopes.filter(asked != "").select(
        "scope_id", F.lit(1).alias("section_no"), F.lit("Asked for").alias("title"),
        F.concat(F.lit("Chosen by "), asked, F.lit(".")).alias("body"), F.array().cast("array<string>").alias("source_document_ids"))
    return heads.unionByName(sections)


def scope_summaries(selected: DataFrame, scopes: DataFrame) -> DataFrame:
    """R8 for ``select_contexts``: (scope_id, summary), also of scopes without documents."""
    kinds = F.array_join(F.array_sort(F.collect_set("source_type")), ", ")
    found = selected.groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"), kinds.alias("kinds"))
    asked = _scope_text("variable", "upload_session_id")
    return scopes.join(found, "scope_id", "left").select("scope_id", F.concat(
        F.lit("Found "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" documents"),
        F.when(asked != "", F.concat(F.lit(" for "), asked)).otherwise(""), F.lit("; their kinds: "),
        F.coalesce(F.nullif("kinds", F.lit("")), F.lit("none")), F.lit(".")).alias("summary"))
