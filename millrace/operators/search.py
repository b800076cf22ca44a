"""Ranked search: postings with positions, document scores, line search, fuzzy terms, suggestions, symbols.

Documents have id, title, headings, content, section, tags and metadata; files have doc_id and text.
The index is a table; searching is a join with the few rows that hold the query's terms.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.functions import text as X
from millrace.functions.predicates import has_any_tag
from millrace.plans.joins import salted_join
from millrace.plans.spread import pieces, widen
from millrace.plans.topn import top_per_key
from millrace.session import cut

K1, B, TITLE_WEIGHT, TITLE_WORDS = 1.5, 0.75, 5.0, 10
SLICES, PAIRS_PER_TASK = 32, 4_000_000


def document_filter(
    df: DataFrame, tags: Sequence[str] = (), section: str | None = None, metadata: Mapping[str, str] | None = None
) -> DataFrame:
    """Any of the tags, an exact section, exact metadata values; a metadata field a document lacks is ignored."""
    if tags:
        df = df.where(has_any_tag("tags", tags))
    if section is not None:
        df = df.where(F.col("section") == section)
    for name, value in (metadata or {}).items():
        held = F.col("metadata")[name]
        df = df.where(~F.map_contains_key("metadata", F.lit(name)) | held.eqNullSafe(F.lit(value)))
    return df


def _once(value: Column, name: str) -> Column:
    """The value as a column of its own: the explode of one struct keeps Catalyst from pasting an expression into every use of it."""
    return F.explode(F.array(F.struct(value.alias("v")))).alias(name)


def _placed_words(docs: DataFrame, key: str, shaped: Callable[[Column], Column] = lambda w: w) -> DataFrame:
    """Rows (key, doc_len, placed), one per document: its words, as ``shaped`` makes them, in order with their positions."""
    none = F.array().cast("array<string>")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    heads = F.flatten(F.transform(F.coalesce("headings", none), lambda h: X.words(h)))
    main = F.concat(X.words(blank("title")), heads, X.words(blank("content")))
    tag_words = F.transform(F.coalesce("tags", none), lambda t: X.words(t))
    base = widen(docs.select(key, "title", "headings", "content", "tags"), key).select(key, _once(F.struct(main.alias("main"), tag_words.alias("tags")), "_w"))
    offset = F.size("_w.v.main")
    placed = F.concat(
        F.transform("_w.v.main", lambda w, i: F.struct(shaped(w).alias("word"), i.alias("position"))),
        F.flatten(F.transform("_w.v.tags", lambda ws: F.transform(ws, lambda w, i: F.struct(shaped(w).alias("word"), (i + offset).alias("position"))))),
    )
    # Lengths are taken before the words are exploded, or every word would carry its whole document.
    return base.select(key, (offset + F.size(F.flatten("_w.v.tags"))).alias("doc_len"), placed.alias("placed"))


def occurrences(docs: DataFrame, key: str = "id") -> DataFrame:
    """Rows (key, doc_len, term, position) over title, headings, content and tags, in that order.

    Positions run on from field to field; every tag starts at the end of the content. Words are split as
    arrays and stemmed after the explode, where the rule list compiles to one expression.
    """
    rows = _placed_words(docs, key).select(key, "doc_len", F.explode("placed").alias("_e"))
    return rows.select(key, "doc_len", X.stem(F.col("_e.word")).alias("term"), F.col("_e.position").alias("position"))


def build_postings(docs: DataFrame, key: str = "id", with_positions: bool = False) -> DataFrame:
    """Rows (term, key, n, first_position, doc_len[, positions]): one per term and document.

    The words of a row are grouped in the row: sorted by term, they are cut where the term changes. So no word is shuffled
    or held in a task's table. Only the postings of rows that share a key meet in a shuffle; keys that repeat are looked up first.
    """
    rows = _placed_words(docs, key, X.stem).select(key, "doc_len", _once(F.sort_array("placed"), "_s")).where(F.size("_s.v") > 0)
    at = lambda i: F.get("_s.v", i)
    size = F.size("_s.v")
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (at(i)["word"] != at(i - 1)["word"]))
    rows = rows.select(key, "doc_len", "_s", _once(ends, "_b"))

    def group(end: Column, j: Column) -> Column:
        start = F.when(j == 0, 0).otherwise(F.get("_b.v", j - 1))
        found = [at(start)["word"].alias("term"), (end - start).cast("bigint").alias("n"), at(start)["position"].alias("first_position")]
        if with_positions:
            # not by slice, which copies the whole array for each of its groups
            found.append(F.transform(F.sequence(start, end - 1), lambda i: at(i)["position"]).alias("positions"))
        return F.struct(*found)

    def grouped(of: DataFrame) -> DataFrame:
        groups = of.select(key, "doc_len", F.explode(F.transform("_b.v", group)).alias("_g"))
        return groups.select("_g.term", key, "_g.n", "_g.first_position", "doc_len", *["_g.positions"] * with_positions)

    repeated = cut(docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.struct(key).alias("_again")), "repeated")
    if repeated.isEmpty():
        return grouped(rows)
    marked = rows.join(repeated, F.struct(key) == F.col("_again"), "left")  # a struct is never null, so null keys meet too
    aggs = [F.sum("n").alias("n"), F.min("first_position").alias("first_position"), F.max("doc_len").alias("doc_len")]
    if with_positions:
        aggs.append(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return grouped(marked.where("_again IS NULL")).union(grouped(marked.where("_again IS NOT NULL")).groupBy("term", key).agg(*aggs))


def document_stats(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: documents and their mean length in terms, the latter read off the postings."""
    terms = postings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    return docs.agg(F.count(F.lit(1)).alias("documents")).withColumn("mean_len", terms / F.col("documents"))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """Rows (query_id, term, weight); a term that a query repeats counts that often."""
    words = queries.select(F.col(query_id), F.explode(X.words(F.col(text))).alias("w"))
    return words.groupBy(query_id, X.stem(F.col("w")).alias("term")).agg(F.count(F.lit(1)).alias("weight"))


def ranked_search(
    postings: DataFrame, stats: DataFrame, queries: DataFrame, query_id: str = "query_id", text: str = "query", key: str = "id",
    limit: int = 10, min_score: float = 0.0, allowed: DataFrame | None = None,
) -> DataFrame:
    """Best documents per query: rows (query_id, key, score, matched_terms, position).

    Only postings of query terms are read on. They are dealt out by document, so that the scores of a document are summed where
    its postings are; the terms of the queries are written first, since Spark knows no size of rows made on the driver, and it
    broadcasts them where they are few. Documents that cannot reach the last place, by the scores of one document in ``SLICES``, are left out before the rest are ranked.
    """
    terms = cut(query_terms(queries, query_id, text), "query_terms")
    hits = postings.join(terms.select("term").distinct(), "term", "left_semi")
    frequency = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    docs, mean = stats.select("documents").scalar(), stats.select("mean_len").scalar()
    idf = F.log((docs + 1) / (F.col("df") + 1)) + 1
    weighted = cut(terms.join(frequency, "term").withColumn("idf", idf), "weighted")
    tf = F.lit(1.0) + F.log(F.col("n"))
    norm = F.lit(1 - B) + F.lit(B) * F.col("doc_len") / mean
    boost = F.when(F.col("first_position") < TITLE_WORDS, TITLE_WEIGHT).otherwise(1.0)
    scored = hits.select("term", key, (tf / (tf + K1 * norm) * boost).alias("_part"))
    if allowed is not None:
        scored = scored.join(allowed.select(key).distinct(), key, "left_semi")
    order = [F.round("score", 9).desc(), F.asc(key)]

    def totals(parts: DataFrame) -> DataFrame:
        matched = salted_join(parts, weighted, ["term"], [key])
        return matched.groupBy(query_id, key).agg(
            F.sum(F.col("_part") * F.col("idf") * F.col("weight")).alias("score"), F.count(F.lit(1)).alias("matched_terms")
        ).where(F.col("score") >= min_score)

    # The last place that some of the documents alone would reach is one that the rest have to reach as well.
    some = top_per_key(totals(scored.where(F.pmod(F.xxhash64(key), F.lit(SLICES)) == 0)), [query_id], order, limit, [key])
    last = some.groupBy(F.struct(query_id).alias("_q")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_last")).where(F.col("_n") >= limit)
    last = cut(last.select("_q", "_last"), "last_places")
    pairs = weighted.agg(F.sum("df").alias("n")).first().n or 0
    parts = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS_PER_TASK))
    dealt = totals(scored.repartition(parts, key)).join(last, F.struct(query_id) == F.col("_q"), "left")
    near = dealt.where("_last IS NULL OR score >= _last - 1e-8").drop("_q", "_last")
    # Sums of floats depend on the order of rows; rounding keeps equal documents equal, and the key decides.
    best = top_per_key(near, [query_id], order, limit, [key])
    place = F.row_number().over(W.partitionBy(query_id).orderBy(*order))
    return best.withColumn("position", place)


def with_excerpts(found: DataFrame, docs: DataFrame, query: str, key: str = "id", length: int = 200) -> DataFrame:
    """Excerpt and highlighted title for the rows of a result page, and for those only."""
    spark = docs.sparkSession
    row = spark.range(1).select(X.words(F.lit(query)).alias("raw"), X.tokens(F.lit(query)).alias("stems")).first()
    # The page is written first, so that Spark sees how small it is and does not shuffle all texts to meet it.
    page = cut(found, "page").join(docs.select(key, "title", "content"), key)
    return page.select(
        *found.columns, X.excerpt(row.stems, length)(F.col("content")).alias("excerpt"), X.highlight(F.col("title"), list(row.raw)).alias("title_marked")
    )


def autocomplete(postings: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Terms with the prefix, by number of documents."""
    return postings.where(F.col("term").startswith(prefix.lower())).groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(limit)


def suggestions(postings: DataFrame, queries: DataFrame, query_id: str, text: str, per_term: int = 5, limit: int = 10) -> DataFrame:
    """For queries without results: frequent terms that share the first three characters of a query term."""
    heads = query_terms(queries, query_id, text).select(query_id, F.substring("term", 1, 3).alias("head"))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("head", F.substring("term", 1, 3))
    top = top_per_key(frequency, ["head"], [F.desc("df"), F.asc("term")], per_term, ["term"])
    found = heads.distinct().join(top, "head").groupBy(query_id, "term").agg(F.max("df").alias("df"))
    return top_per_key(found, [query_id], [F.desc("df"), F.asc("term")], limit, ["term"])


def remove_documents(postings: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return salted_join(postings, gone.select(key).distinct(), [key], ["term"], "left_anti")


def upsert_documents(postings: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """Re-indexes the given documents: their old postings go, their new ones come."""
    return remove_documents(postings, docs, key).unionByName(build_postings(docs, key).select(*postings.columns))



# --- line index ---------------------------------------------------------------------------------------


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, line_no, line), numbered from 1."""
    return pieces(docs.select(key, text), key).select(F.col(key), F.posexplode(F.split(text, "\r\n|\n|\r")).alias("_i", "line")).select(
        key, (F.col("_i") + 1).alias("line_no"), "line"
    )


def line_tokens(lines: DataFrame, key: str = "doc_id", max_line: int | None = None, split_camel: bool = True, with_column: bool = True) -> DataFrame:
    """Rows (key, line_no, ord, token[, column]): every token of every line, or of those of at most ``max_line`` characters."""
    kept = lines if max_line is None else lines.where(F.length("line") <= max_line)
    if not with_column:
        return kept.select(key, "line_no", F.posexplode(X.code_tokens(F.col("line"), split_camel)).alias("ord", "token"))
    rows = kept.select(key, "line_no", F.lower("line").alias("_low"), _once(X.code_tokens(F.col("line"), split_camel), "_t"))
    # Columns are looked up inside the line, or every token would carry its line and lower it again.
    column = lambda t: F.greatest(F.instr(F.col("_low"), t) - 1, F.lit(0))
    placed = F.transform("_t.v", lambda t, i: F.struct(i.alias("ord"), t.alias("token"), column(t).alias("column")))
    return rows.select(key, "line_no", F.explode(placed).alias("_e")).select(key, "line_no", "_e.ord", "_e.token", "_e.column")


def capped_matches(tokens: DataFrame, cap: int, key: str = "doc_id") -> DataFrame:
    """First ``cap`` matches of each token in file order, for an index that may lose places of common words."""
    return top_per_key(tokens, ["token"], [F.asc(key), F.asc("line_no"), F.asc("ord")], cap, [key, "line_no"])


def split_query(query: str) -> list[str]:
    found = (w.lower() for w in re.findall(X.CODE_WORD, query))
    return [w for w in found if w not in set(X.CODE_STOP_WORDS)]


def all_terms(matches: DataFrame, terms: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Lines (key, line_no) that hold every term."""
    wanted = sorted(set(terms))
    hits = matches.where(F.col("token").isin(wanted)).groupBy(key, "line_no").agg(F.count_distinct("token").alias("_n"))
    return hits.where(F.col("_n") == len(wanted)).drop("_n")


def similar_tokens(vocabulary: DataFrame, words: DataFrame, threshold: float = 0.5, limit: int = 5, n: int = 3) -> DataFrame:
    """Rows (word, token, similarity): tokens whose padded n-grams overlap by at least ``threshold`` (Jaccard), the first ``limit`` a word.

    Grams have one order, rare ones first. Two sets can only be similar if they share one of their first grams, a share
    of them that the threshold leaves, at places that leave room for the overlap asked for; so strings meet on rare grams,
    never on one that most of them have, and only those that met are compared. Null strings match nothing.
    """
    asked, offered = words.select("word").where("word is not null").distinct(), vocabulary.select("token").where("token is not null").distinct()
    sides = asked.select(F.col("word").alias("s"), F.lit(0).alias("side")).union(offered.select(F.col("token").alias("s"), F.lit(1).alias("side")))
    grams = cut(sides.select("s", "side", F.explode(X.ngrams(F.col("s"), n)).alias("gram")), "grams")
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = salted_join(grams, often, ["gram"], ["s"]).groupBy("s", "side").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    sets = cut(ranked.select("s", "side", F.transform("g", lambda x: x["gram"]).alias("g"), F.size("g").alias("size")), "gram_sets")
    # one gram less than the threshold asks for is left out, so that rounding loses no pair
    first = F.slice("g", 1, F.least(F.col("size"), F.col("size") - F.ceil(F.col("size") * F.lit(threshold)) + 2).cast("int"))
    prefix = sets.select("side", "s", "size", "g", F.posexplode(first).alias("at", "gram"))
    left = prefix.where("side = 0").select("gram", F.col("s").alias("word"), F.col("size").alias("a"), F.col("g").alias("x"), F.col("at").alias("i"))
    right = prefix.where("side = 1").select("gram", F.col("s").alias("token"), F.col("size").alias("b"), F.col("g").alias("y"), F.col("at").alias("j"))
    room = F.least(F.col("a") - F.col("i"), F.col("b") - F.col("j")) + F.least("i", "j")
    fits = (F.col("a") >= F.col("b") * threshold - 1e-9) & (F.col("b") >= F.col("a") * threshold - 1e-9) & (room * (1 + threshold) >= (F.col("a") + F.col("b")) * threshold - 1e-9)
    met = right.join(left, "gram").where(fits).dropDuplicates(["word", "token"])
    common = F.size(F.array_intersect("x", "y"))
    scored = met.withColumn("similarity", common / (F.col("a") + F.col("b") - common)).where(F.col("similarity") >= threshold)
    return top_per_key(scored.select("word", "token", "similarity"), ["word"], [F.desc("similarity"), F.asc("token")], limit, ["token"])


def line_search(
    lines: DataFrame, tokens: DataFrame, query: str, fuzzy: bool = False, threshold: float = 0.5, key: str = "doc_id",
    cap: int | None = None, limit: int = 50,
) -> DataFrame:
    """Lines that hold every word of the query, scored by the TF-IDF of their file plus 0.1 per word in the line.

    Fuzzy expansion adds at most five tokens per word, to the score only.
    """
    words = split_query(query)
    expanded = list(words)
    if fuzzy and words:
        asked = lines.sparkSession.createDataFrame([(w,) for w in sorted(set(words))], "word string")
        near = similar_tokens(tokens, asked, threshold).orderBy("word", F.desc("similarity"), "token").collect()
        for word in words:
            expanded += [r.token for r in near if r.word == word and r.token not in expanded]
    if not words:
        return lines.where(F.lit(False)).select(key, "line_no", "line", F.lit(0.0).alias("score"))
    asked = tokens.where(F.col("token").isin(sorted(set(words))))
    common = all_terms(asked if cap is None else capped_matches(asked, cap, key), words, key)

    doc_len = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("doc_len"))
    documents = lines.select(key).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    weight = F.create_map(*[x for t in sorted(set(expanded)) for x in (F.lit(t), F.lit(expanded.count(t)))])
    counts = tokens.where(F.col("token").isin(sorted(set(expanded)))).groupBy("token", key).agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((documents + 1) / (F.col("df") + 1)) + 1
    parts = salted_join(counts, df, ["token"], [key]).join(doc_len, key)
    doc_scores = parts.groupBy(key).agg(F.sum(F.col("n") / F.col("doc_len") * idf * weight[F.col("token")]).alias("tf_idf"))

    low = F.lower("line")
    contained = sum((F.when(low.contains(t), 1).otherwise(0) for t in expanded[1:]), F.when(low.contains(expanded[0]), 1).otherwise(0))
    hits = lines.join(common, [key, "line_no"], "left_semi").join(doc_scores, key)
    return hits.select(key, "line_no", F.trim("line").alias("line"), F.round(F.col("tf_idf") + contained * 0.1, 9).alias("score")).orderBy(
        F.desc("score"), key, "line_no"
    ).limit(limit)


def fuzzy_matches(words: DataFrame, candidates: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows (word, candidate, similarity) by edit distance, case aside; ``threshold`` must be above 0.

    For two lengths the threshold allows a number d of edits. A candidate is cut into d + 1 even segments, one of which d edits
    leave whole, so a word has to hold it, at most a few places away. Words and candidates meet on those segments and on
    nothing else; where lengths are so short that d edits can change everything, they meet on their lengths. Nulls match
    nothing. Candidates are dealt out before they are cut up, since a vocabulary of few bytes makes dozens of segments a word.
    """
    if threshold <= 0:
        raise ValueError("every string is similar at a threshold of 0 or below")
    asked = _segments(words.select("word").where("word is not null").distinct(), "word", threshold, True)
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    offered = candidates.select("candidate").where("candidate is not null").distinct().repartition(parts)
    given = _segments(offered, "candidate", threshold, False)
    met = given.join(asked, "key").select("word", "candidate").distinct()
    return met.withColumn("similarity", X.similarity(F.col("word"), F.col("candidate"))).where(F.col("similarity") >= threshold)


def _segments(df: DataFrame, name: str, threshold: float, asks: bool) -> DataFrame:
    """(name, key): the segments of a candidate for each length of a word that may match it, or what a word has where they might be.

    A word may have one part at several places, which count once; those of a candidate are all different.
    """
    own, text = F.length(name), F.lower(name)
    other = F.sequence(F.floor(own * F.lit(threshold)).cast("int"), F.ceil(own / F.lit(threshold)).cast("int"))
    rows = df.select(name, text.alias("t"), F.length(text).alias("own"), own.alias("given"), F.explode(other).alias("other"))
    a, b = ("given", "other") if asks else ("other", "given")  # lengths of the word and of the candidate
    edits = F.floor((1 - F.lit(threshold)) * F.greatest("given", "other") + 1e-9).cast("int")
    rows = rows.select(name, "t", F.col(a).alias("a"), F.col(b).alias("b"), edits.alias("d")).where(F.abs(F.col("a") - F.col("b")) <= F.col("d"))
    lengths = [F.col("a"), F.col("b")]
    short = rows.where(F.col("d") >= F.col("b")).select(name, F.struct(*lengths, F.lit(-1).alias("i"), F.lit("").alias("part")).alias("key"))
    cuts = rows.where(F.col("d") < F.col("b")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    base = F.floor(F.col("b") / (F.col("d") + 1)).cast("int")
    small = F.col("d") + 1 - F.col("b") % (F.col("d") + 1)  # the first segments are one shorter than the rest
    start = F.col("i") * base + F.greatest(F.col("i") - small, F.lit(0))
    size = base + (F.col("i") >= small).cast("int")
    if asks:
        # edits before the segment move it by as many places at most, those after it likewise from the other end
        moved = F.col("a") - F.col("b")
        low = F.greatest(F.lit(0), start - F.col("i"), start + moved - (F.col("d") - F.col("i")))
        high = F.least(F.col("a") - size, start + F.col("i"), start + moved + (F.col("d") - F.col("i")))
        cuts = cuts.withColumns({"low": low, "high": high, "size": size}).where("low <= high").withColumn("start", F.explode(F.sequence(F.col("low"), F.col("high"))))
    else:
        cuts = cuts.withColumns({"start": start, "size": size})
    part = F.substring("t", F.col("start") + 1, F.col("size"))
    keys = cuts.select(name, F.struct(*lengths, "i", part.alias("part")).alias("key"))
    both = short.union(keys)
    return both.distinct() if asks else both


def prefix_lines(matches: DataFrame, prefix: str, key: str = "doc_id", per_token: int = 5, limit: int = 30) -> DataFrame:
    """Lines with a token that starts with the prefix: five matches per token, each line once."""
    hits = top_per_key(matches.where(F.col("token").startswith(prefix.lower())), ["token"], [F.asc(key), F.asc("line_no"), F.asc("ord")], per_token, [key])
    return hits.groupBy(key, "line_no").agg(F.min("token").alias("token")).orderBy("token", key, "line_no").limit(limit)


def substring_search(df: DataFrame, term: str, fields: Sequence[str]) -> DataFrame:
    """Rows with the term, ignoring case, in any of the fields (lists and maps as text); adds the first field that has it."""
    low = term.lower()

    def held(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        shown = F.to_json(name) if kind in ("array", "map", "struct", "variant") else F.col(name).cast("string")
        return F.coalesce(F.lower(shown).contains(low), F.lit(False))

    first = F.coalesce(*[F.when(held(f), F.lit(f)) for f in fields])
    return df.withColumn("found_in", first).where("found_in IS NOT NULL")


# Symbol patterns per language, tried in this order on a line.
SYMBOL_PATTERNS = {
    "python": (
        (r"^\s*class\s+(\w+)", "class"), (r"^\s*def\s+(\w+)", "function"), (r"^\s*async\s+def\s+(\w+)", "function"), (r"^(\w+)\s*=\s*", "variable"),
    ),
    "javascript": (
        (r"^\s*class\s+(\w+)", "class"), (r"^\s*(?:async\s+)?function\s+(\w+)", "function"), (r"^\s*(?:export\s+)?const\s+(\w+)", "constant"),
        (r"^\s*(?:export\s+)?let\s+(\w+)", "variable"), (r"^\s*(?:export\s+)?interface\s+(\w+)", "interface"), (r"^\s*(?:export\s+)?type\s+(\w+)", "type"),
    ),
    "rust": (
        (r"^\s*(?:pub\s+)?struct\s+(\w+)", "struct"), (r"^\s*(?:pub\s+)?enum\s+(\w+)", "enum"), (r"^\s*(?:pub\s+)?fn\s+(\w+)", "function"),
        (r"^\s*(?:pub\s+)?trait\s+(\w+)", "trait"), (r"^\s*(?:pub\s+)?type\s+(\w+)", "type"), (r"^\s*impl(?:\s+\w+)?\s+(?:for\s+)?(\w+)", "impl"),
    ),
}


def symbols(lines: DataFrame, language: str = "language") -> DataFrame:
    """Adds name, kind and signature of the symbol a line defines; lines without one drop out.

    The first pattern that matches and gives an allowed name decides; private names count only for
    functions and classes. TypeScript follows the JavaScript patterns.
    """
    rules = {**SYMBOL_PATTERNS, "typescript": SYMBOL_PATTERNS["javascript"]}
    chain = F
    for lang, patterns in rules.items():
        for pattern, kind in patterns:
            name = F.regexp_extract("line", pattern, 1)
            ok = (F.col(language) == lang) & (name != "")
            if kind not in ("function", "class"):
                ok = ok & ~name.startswith("_")
            chain = chain.when(ok, F.struct(name.alias("name"), F.lit(kind).alias("kind")))
    found = chain.otherwise(F.lit(None))
    # Exploding drops lines without a symbol and evaluates the patterns once per line.
    out = lines.withColumn("_s", F.explode(F.array_compact(F.array(found))))
    return out.withColumns({"name": F.col("_s.name"), "kind": F.col("_s.kind"), "signature": F.substring(F.trim("line"), 1, 100)}).drop("_s")


def symbol_search(found: DataFrame, query: str, kind: str | None = None, limit: int = 30, order: Sequence[str] = ("name",)) -> DataFrame:
    hits = found.where(F.lower("name").contains(query.lower()))
    return (hits.where(F.col("kind") == kind) if kind else hits).orderBy(*order).limit(limit)


def index_statistics(matches: DataFrame, documents: DataFrame, symbol_rows: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """One row: distinct tokens, kept matches, documents, symbols, matches per token."""
    per_token = matches.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    docs = documents.agg(F.count_distinct(key).alias("n")).scalar()
    syms = F.lit(0).cast("bigint") if symbol_rows is None else symbol_rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = per_token.agg(F.count(F.lit(1)).alias("total_tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"))
    return out.withColumns({"total_documents": docs, "total_symbols": syms, "avg_matches_per_token": F.coalesce(F.try_divide("total_matches", "total_tokens"), F.lit(0.0))})


def file_terms(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, token): the distinct tokens of every file."""
    return tokens.select(key, "token").distinct()


def metadata_search(docs: DataFrame, query: str | None, searchable: Sequence[str], filters: Mapping[str, object], filterable: Sequence[str],
                    sort: Sequence[str], sortable: Sequence[str], page: int = 1, per_page: int = 20) -> DataFrame:
    """Search over model or run documents: text in searchable fields, exact filters, sort and page.

    Filters and sort fields outside the allowed lists raise.
    """
    from millrace.operators.scopes import sorted_page

    for name in filters:
        if name not in filterable:
            raise ValueError(f"{name} is not filterable")
    for name in sort:
        if name.lstrip("-") not in sortable:
            raise ValueError(f"{name} is not sortable")
    for name, value in filters.items():
        is_list = docs.schema[name].dataType.typeName() == "array"
        docs = docs.where(F.array_contains(name, value) if is_list else F.col(name) == F.lit(value))
    if query:
        docs = substring_search(docs, query, searchable).drop("found_in")
    return sorted_page(docs, list(sort), page, per_page)



def export_documents(docs: DataFrame) -> DataFrame:
    """Documents for a client-side index: content to 1000 characters, an excerpt of 300, five headings."""
    content = F.coalesce("content", F.lit(""))
    excerpt = F.when(F.length(content) > 300, F.concat(F.substring(content, 1, 300), F.lit("..."))).otherwise(content)
    return docs.select("id", "url", "title", F.substring(content, 1, 1000).alias("content"), excerpt.alias("excerpt"), "section", "tags", F.slice("headings", 1, 5).alias("headings"))
