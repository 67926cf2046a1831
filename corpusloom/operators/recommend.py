"""Folder suggestions: candidate sources, ranking, feedback, patterns, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.folds import fold_in_order

#: Weights of suggestion sources.
WEIGHTS = {"llm": 1.5, "user_pattern": 1.2, "semantic": 1.1, "cluster": 1.1, "pattern": 1.0, "strategy": 1.0, "llm_creative": 0.7}


def source_weight(source: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in WEIGHTS.items():
        out = F.when(source == name, weight).otherwise(out)
    return out


def ranked(candidates: DataFrame) -> DataFrame:
    """(file, folder, score, confidence, source, sources, rank) of candidates (file, folder, score, confidence, source).

    Folders are the same whatever their case; the best weighted score and confidence count,
    with the source of the most confident. Two sources add a fifth, a user's pattern three tenths.
    """
    c = candidates.withColumn("key", F.lower(F.trim("folder"))).withColumn("weighted", F.col("score") * source_weight(F.col("source")))
    best = F.max_by("source", F.struct("confidence", "source"))
    g = c.groupBy("file", "key").agg(F.min("folder").alias("folder"), F.max("weighted").alias("score"), F.max("confidence").alias("confidence"), best.alias("source"), F.count_distinct("source").alias("sources"), F.max((F.col("source") == "user_pattern").cast("int")).alias("user"))
    conf = F.col("confidence") * F.when(F.col("sources") > 1, 1.2).otherwise(1.0) * F.when(F.col("user") == 1, 1.3).otherwise(1.0)
    g = g.withColumn("confidence", F.round(F.least(F.lit(1.0), conf), 2)).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("file").orderBy(F.desc("score"), F.desc("confidence"), "folder")
    return g.withColumn("rank", F.row_number().over(w)).drop("key", "user")


def penalised(df: DataFrame, known: DataFrame) -> DataFrame:
    """Score and confidence of folders that don't exist are 0.2 at most."""
    k = known.select(F.lower("folder").alias("_k"), F.lit(True).alias("_known")).distinct()
    j = df.join(k, F.lower("folder") == F.col("_k"), "left")
    low = lambda c: F.when(F.col("_known").isNull(), F.least(F.lit(0.2), F.col(c))).otherwise(F.col(c)).alias(c)
    return j.select(*(low(c) if c in ("score", "confidence") else F.col(c) for c in df.columns))


def folder_fit(name_a: Column, name_b: Column, text_a: Column, text_b: Column, category: Column, words_a: Column, words_b: Column) -> Column:
    return 0.3 * T.overlap(name_a, name_b) + 0.3 * T.overlap(text_a, text_b) + F.when(F.contains(F.lower(F.array_join(name_b, " ")), F.lower(category)), 0.2).otherwise(0.0) + 0.2 * T.jaccard(words_a, words_b)


def learned_patterns(feedback: DataFrame) -> DataFrame:
    """(key, count, confidence, alive) of feedback (key, ts, id, accepted), folded in order for each key.

    Accepting adds 0.1 from 0.5 up to 1, rejecting takes 0.15; under 0.1 a pattern is dropped
    and begins anew.
    """

    def step(state, accepted):
        count, conf = state
        if accepted:
            return (count + 1, 0.5 if conf is None else min(1.0, conf + 0.1)), []
        if conf is not None and conf - 0.15 < 0.1:
            return (0, None), []
        return (count, None if conf is None else conf - 0.15), []

    return fold_in_order(feedback, "key", ["ts", "id"], ["accepted"], "key string, count long, confidence double, alive boolean", start=lambda: (0, None), step=step, finish=lambda s: [(s[0], round(s[1] or 0.0, 4), s[1] is not None)])


def unique_names(df: DataFrame, *, dir_col: str, name_col: str, order_col: str) -> DataFrame:
    """Names made unique in their folder whatever the case: base-2.ext, base-3.ext, skipping those in use.

    A name's m-th repetition takes the m-th number from 2 on that no name of the folder has. A
    number in use moves all repetitions on that would take it or a later one: with numbers in use
    and repetitions in one order, that is a running count, so nothing is gathered for a name.
    """
    rows = df.select(F.col(dir_col).alias("d"), F.col(name_col).alias("n"), F.col(order_col).cast("long").alias("o"), F.lower(name_col).alias("l"))
    numbered = r"(?s)^(.*)-([2-9]|[1-9][0-9]+)(\.[^.]*)?$"
    base, ext = F.regexp_extract("l", numbered, 1), F.regexp_extract("l", numbered, 3)
    used = rows.select("d", "l").distinct().where(F.col("l").rlike(numbered)).select("d", F.concat(base, ext).alias("l"), F.regexp_extract("l", numbered, 2).cast("long").alias("k"))
    rank = F.row_number().over(Window.partitionBy("d", "l").orderBy("k"))
    used = used.where("k IS NOT NULL").distinct().select("d", "l", (F.col("k") - rank + 1).alias("nth"), F.lit(0).alias("kind"))
    nth = F.row_number().over(Window.partitionBy("d", "l").orderBy("o"))
    both = rows.withColumns({"nth": nth.cast("long"), "kind": F.lit(1)}).unionByName(used, allowMissingColumns=True)
    before = F.sum(1 - F.col("kind")).over(Window.partitionBy("d", "l").orderBy("nth", "kind").rowsBetween(Window.unboundedPreceding, 0))
    j = both.withColumn("free", F.col("nth") + before).where("kind = 1")
    free = F.col("free")
    dot = F.length("n") - F.instr(F.reverse("n"), ".")  # characters before the last point
    has = F.instr("n", ".") > 0
    new = F.when(has, F.concat(F.substring("n", F.lit(1), dot), F.lit("-"), free.cast("string"), F.substring("n", dot + 1, F.length("n")))).otherwise(F.concat("n", F.lit("-"), free.cast("string")))
    return j.select(F.col("d").alias(dir_col), F.col("o").alias(order_col), F.when(F.col("nth") == 1, F.col("n")).otherwise(new).alias("unique_name"))


def moves(deleted: DataFrame, added: DataFrame, *, tolerance_s: float = 2.0) -> DataFrame:
    """(deleted, added): files that were moved, given as (id, path, size, s) with the time in seconds.

    Size and extension (whatever its case) are equal and times at most ``tolerance_s`` apart, to
    the millionth. An added file with several candidates takes the one with its own base name, if
    that is one alone; else it is no move. Candidates are never listed: how many there are, and the
    first, is what windows over the times around an added file say, of all and of its name's
    deletes. Time is cut into stretches of the tolerance, so a size that has most files is many
    windows. Rows without a size or a time are no candidates.
    """
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    ext = F.regexp_extract(base, r".(\.[^.]*)$", 1)
    reach = max(1, round(tolerance_s * 1e6))
    fine = F.round(F.col("s") * 1e6).cast("long")
    at = F.floor(fine / reach)
    row = lambda df, stretch: df.where("size IS NOT NULL AND s IS NOT NULL AND path IS NOT NULL").select(F.col("id"), base.alias("base"), ext.alias("ext"), "size", fine.alias("fine"), stretch.alias("b"))
    d = row(deleted, F.explode(F.array(at - 1, at, at + 1))).withColumn("gone", F.col("id"))
    rows = d.unionByName(row(added, at).withColumn("gone", F.lit(None).cast(d.schema["gone"].dataType)))
    near = Window.partitionBy("size", "ext", "b").orderBy("fine").rangeBetween(-reach, reach)
    named = Window.partitionBy("size", "ext", "b", "base").orderBy("fine").rangeBetween(-reach, reach)
    told = rows.select("id", "gone", F.count("gone").over(near).alias("n"), F.min("gone").over(near).alias("only"), F.count("gone").over(named).alias("n_named"), F.min("gone").over(named).alias("namesake"))
    one = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_named") == 1, F.col("namesake"))
    return told.where("gone IS NULL").select(one.alias("deleted"), F.col("id").alias("added")).where("deleted IS NOT NULL")


def match_patterns(files: DataFrame, patterns: DataFrame, *, least: float = 0.5, most: int = 3) -> DataFrame:
    """(file, pattern, similarity, score, rank): learned patterns that share segments with a file at their places.

    ``files``: (file, parts: list), ``patterns``: (pattern, parts, confidence). The similarity is
    the share of equal segments of the longer list, at least ``least``; the score, times the
    pattern's confidence, ranks the first ``most``. Both sides meet on (place, segment), files
    with equal parts once.
    """
    once = files.select("parts").distinct()
    f = once.select("parts", F.size("parts").alias("n1"), F.posexplode("parts").alias("at", "segment"))
    p = patterns.select("pattern", "confidence", F.size("parts").alias("n2"), F.posexplode("parts").alias("at", "segment"))
    s = f.join(p, ["at", "segment"]).groupBy("parts", "pattern").agg((F.count("*") / F.max(F.greatest("n1", "n2"))).alias("similarity"), F.max("confidence").alias("confidence"))
    s = s.where(F.col("similarity") >= least).withColumn("score", F.round(F.col("similarity") * F.col("confidence"), 9))
    rank = F.row_number().over(Window.partitionBy("parts").orderBy(F.desc("score"), "pattern"))
    return files.join(s.withColumn("rank", rank).where(F.col("rank") <= most), "parts").select("file", "pattern", "similarity", "score", "rank")


def canonical(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


#: Categories that say nothing, and the folder for them.
GENERIC, NOWHERE = ("", "document", "documents", "file", "files", "other", "general", "misc", "miscellaneous", "unknown", "uncategorized"), "Uncategorized"


def match_categories(categories: DataFrame, folders: DataFrame) -> DataFrame:
    """(category, folder, step) of distinct categories: equal, equal in canonical form, near in spelling, sharing words, else nowhere.

    Spelling: at most 2 edits, 3 in names of more than 10 characters, the fewest first. Words:
    shared ones over the longer list, less a hundredth for each further word (a quarter at
    most), above one half. Candidates for both meet on keys, segments of names and words, so
    nothing is compared with everything.
    """
    c = categories.select("category").where(F.col("category").isNotNull()).distinct().withColumn("form", canonical(F.col("category")))
    f = folders.select(F.col("folder")).distinct().withColumn("form", canonical(F.col("folder")))
    generic = F.lower(F.trim("category")).isin(*GENERIC)
    exact = c.join(f.select(F.col("folder").alias("hit"), "folder"), F.col("category") == F.col("hit")).select("category", "folder", F.lit(1).alias("step"), F.lit(0.0).alias("cost"))
    same = c.join(f, "form").where("form <> ''").select("category", "folder", F.lit(2).alias("step"), F.lit(0.0).alias("cost"))
    # Of four segments of a name, three edits leave one as it is, at most three places from where it was.
    begin, size = (lambda n, i: F.floor(i * n / 4)), (lambda n, i: F.floor((i + 1) * n / 4) - F.floor(i * n / 4))
    segments = F.array(*map(F.lit, range(4)))
    n = F.length("form")
    own = F.transform(segments, lambda i: F.concat_ws(":", n, i, F.col("form").substr(begin(n, i).cast("int") + 1, size(n, i).cast("int"))))
    shifted = lambda m, i: F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda d: F.concat_ws(":", m, i, F.col("form").substr(F.greatest(begin(m, i).cast("int") + d, F.lit(0)) + 1, size(m, i).cast("int"))))
    around = F.flatten(F.transform(F.sequence(F.greatest(n - 3, F.lit(1)), n + 3), lambda m: F.flatten(F.transform(segments, lambda i: shifted(m, i)))))
    keys = lambda df, which: df.where("form <> ''").withColumn("key", F.explode(F.array_distinct(which)))
    near = keys(c, around).select("category", F.col("form").alias("x"), "key").join(keys(f, own).select("folder", F.col("form").alias("y"), "key"), "key").select("category", "folder", "x", "y").distinct()
    near = near.select("category", "folder", F.levenshtein("x", "y").alias("d"), F.when(F.length("x") > 10, 3).otherwise(2).alias("most"))
    near = near.where("d <= most").select("category", "folder", F.lit(3).alias("step"), F.col("d").cast("double").alias("cost"))
    words = lambda df: df.withColumn("w", F.array_distinct(F.split("form", " "))).withColumn("word", F.explode("w")).where("word <> ''")
    shared = words(c).select("category", F.size("w").alias("n1"), "word").join(words(f).select("folder", F.size("w").alias("n2"), "word"), "word").groupBy("category", "folder").agg(F.count("*").alias("n"), F.max(F.greatest("n1", "n2")).alias("most"))
    score = F.col("n") / F.col("most") - F.least(F.lit(0.25), 0.01 * (F.col("most") - F.col("n")))
    shared = shared.select("category", "folder", F.lit(4).alias("step"), (-score).alias("cost")).where("cost < -0.5")
    found = exact.unionByName(same).unionByName(near).unionByName(shared)
    best = found.groupBy("category").agg(F.min(F.struct("step", "cost", "folder")).alias("m"))
    j = c.join(best, "category", "left")
    return j.select("category", F.when(generic, F.lit(NOWHERE)).otherwise(F.coalesce("m.folder", F.lit(NOWHERE))).alias("folder"), F.when(generic, F.lit(0)).otherwise(F.coalesce("m.step", F.lit(0))).alias("step"))


def folder_similarity(name_a: Column, name_b: Column, words_a: Column, words_b: Column, tags_a: Column, tags_b: Column) -> Column:
    """0.4 for names, 0.3 for descriptions, 0.3 for keywords."""
    return 0.4 * T.overlap(name_a, name_b) + 0.3 * T.overlap(words_a, words_b) + 0.3 * T.jaccard(tags_a, tags_b)


def overlapping_folders(folders: DataFrame, least: float = 0.7, most: int = 100) -> DataFrame:
    """(a, b, score) of folders (folder, name, words, tags: lists) of a similarity above ``least``, the first ``most``.

    Folders that share no word of any kind have similarity 0, so pairs meet on words.
    """
    f = folders.select("folder", "name", "words", "tags").distinct()
    kinds = F.flatten(F.array(*(F.transform(F.array_distinct(c), lambda w, c=c: F.concat(F.lit(f"{c}:"), w)) for c in ("name", "words", "tags"))))
    e = f.withColumn("key", F.explode(kinds))
    pairs = e.select(F.col("folder").alias("a"), "key").join(e.select(F.col("folder").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    side = lambda n: f.select(F.col("folder").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("name", "words", "tags")))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    score = folder_similarity(F.col("name_a"), F.col("name_b"), F.col("words_a"), F.col("words_b"), F.col("tags_a"), F.col("tags_b"))
    return j.select("a", "b", F.round(score, 6).alias("score")).where(F.col("score") > least).orderBy(F.desc("score"), "a", "b").limit(most)


def missing_categories(files: DataFrame, folders: DataFrame, names: list[str]) -> DataFrame:
    """(category) of the given names that no folder (folder) has and some file (category) does, whatever the case; names are a list in code."""
    wanted = files.sparkSession.createDataFrame([(n,) for n in names], "category string").withColumn("_l", F.lower("category"))
    seen = lambda df, c: [F.max(F.contains(F.lower(c), F.lit(n.lower()))).alias(f"c{k}") for k, n in enumerate(names)]
    hits = lambda df, c: df.agg(*seen(df, c)).select(F.explode(F.array(*(F.struct(F.lit(n.lower()).alias("_l"), F.coalesce(f"c{k}", F.lit(False)).alias("hit")) for k, n in enumerate(names)))).alias("r")).where("r.hit").select("r._l")
    return wanted.join(hits(folders, "folder"), "_l", "left_anti").join(hits(files, "category"), "_l", "left_semi").select("category")


def category_override(category: Column, confidence: Column, folder: Column, cosine: Column, *, least: float = 0.65) -> Column:
    """The nearest folder instead of a model's category, if near enough and surer; a category that says nothing has no confidence."""
    sure = F.when(F.lower(F.trim(F.coalesce(category, F.lit("")))).isin(*GENERIC), 0.0).otherwise(F.coalesce(confidence, F.lit(0.0)))
    return F.when(folder.isNotNull() & (cosine >= least) & (cosine > sure), folder).otherwise(category)


def organise_decision(folder: Column, confidence: Column, resolved: Column, *, threshold: float = 0.75, default_folder: Column | None = None) -> Column:
    """organise, review, low-confidence-default; without a suggestion, or an unknown place for one, review."""
    low = F.lit("review") if default_folder is None else F.when(default_folder.isNotNull(), "low-confidence-default").otherwise("review")
    return F.when(folder.isNull() | confidence.isNull(), "review").when((confidence >= threshold) & resolved, "organise").when(confidence >= threshold, "review").otherwise(low)


def model_suggestion(names: list[Column], confidence: Column, folder: Column) -> Column:
    """struct(given, score) of a model's first non-empty name against the ``folder`` it was matched to.

    Percents become shares, without a confidence it is 0.6; names that are equal, contain one
    another, or are near in spelling (3 edits, or three tenths of the longer) count 0.95 at least.
    """
    given = F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names))
    c = F.when(confidence.isNull(), 0.6).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(confidence > 1, confidence / 100).otherwise(confidence))))
    a, b = canonical(given), canonical(folder)
    edits = F.levenshtein(a, b)
    good = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | (edits <= 3) | (edits < 0.3 * F.greatest(F.length(a), F.length(b))))
    return F.struct(given.alias("given"), F.when(given.isNotNull() & good, F.greatest(c, F.lit(0.95))).otherwise(c).alias("score"))


def cluster_folders(clusters: DataFrame, folders: DataFrame) -> DataFrame:
    """(cluster, folder, score, new) for labelled clusters (cluster, label): the best existing folder, else a new one of the label.

    Equal or contained names score 0.85, a word overlap above 0.3 eight tenths of it, a new
    folder 0.6. Folders are compared by the pieces of their words, so only those that share
    characters with a label meet it, and clusters of the same label meet them once.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(canonical(c), " "), lambda w: w != ""))
    c = clusters.select("label").distinct().select("label", canonical(F.col("label")).alias("x"), words(F.col("label")).alias("wx"))
    f = folders.select("folder").distinct().select("folder", canonical(F.col("folder")).alias("y"), words(F.col("folder")).alias("wy"))
    # A name that contains another one has its first three characters somewhere.
    grams = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(n) - 2, F.lit(1))), lambda i: F.col(n).substr(i, F.lit(3))))
    pairs = c.withColumn("g", F.explode(grams("x"))).join(f.withColumn("g", F.explode(grams("y"))), "g").drop("g").distinct()
    inside = (F.col("x") == F.col("y")) | ((F.length("x") > 0) & (F.length("y") > 0) & (F.contains("x", "y") | F.contains("y", "x")))
    near = T.overlap(F.col("wx"), F.col("wy"))
    scored = pairs.select("label", "folder", F.when(inside, 0.85).when(near > 0.3, near * 0.8).alias("score")).where("score IS NOT NULL")
    best = scored.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("cost"), "folder")).alias("m"))
    j = clusters.select("cluster", "label").join(best, "label", "left")
    return j.select("cluster", F.coalesce("m.folder", "label").alias("folder"), F.coalesce(-F.col("m.cost"), F.lit(0.6)).alias("score"), F.col("m.folder").isNull().alias("new"))


def rule_category(name: Column, ext: Column, keywords: dict[str, list[str]], by_ext: dict[str, str], default: str = "Documents") -> Column:
    """The category whose keywords have most characters in a file's name, of equals the first named; else by extension."""
    n = F.lower(name)
    scores = {k: sum((F.when(F.contains(n, F.lit(w.lower())), len(w)).otherwise(0) for w in ws), F.lit(0)) for k, ws in keywords.items()}
    out = F.lit(default)
    for e, category in by_ext.items():
        out = F.when(F.lower(ext) == e, category).otherwise(out)
    best = F.greatest(F.lit(0), F.lit(0), *scores.values())
    for k, s in reversed(scores.items()):
        out = F.when((best > 0) & (s == best), k).otherwise(out)
    return out


def containing(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_id, term_id): which texts (text_id, text) contain which terms (term_id, term), not only as words.

    A term meets the texts that have its first characters, three at most, anywhere: an equi-join
    on short grams, of which each text sends its distinct ones, and a check of what is found.
    Empty terms are in no text.
    """
    t = terms.where(F.length("term") > 0).select("term_id", "term", F.substring("term", 1, 3).alias("gram"))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: i + n <= F.length("text") + 1), lambda i: F.substring("text", i, n)))))
    rows = texts.where(F.col("text").isNotNull()).select("text_id", "text", F.explode(grams).alias("gram"))
    return rows.join(t, "gram").where(F.contains("text", F.col("term"))).select("text_id", "term_id")


#: Points for what of a folder stands in a file's name, and for its extension.
FOLDER_POINTS = {"name": 10, "name_word": 8, "description": 6, "tag": 5, "keyword": 4, "path": 3, "category": 2, "related": 1}
EXTENSION_POINTS = {"description": 15, "keyword": 12, "tag": 10}


def score_folders(files: DataFrame, folders: DataFrame, *, least: float = 5.0, sure: float = 0.8, bonus: float = 1.2, all_scores: bool = False) -> DataFrame:
    """(file, folder, score): the folder with most points for each file (file, name), of equals the first by name.

    ``folders``: folder (its name), and as far as they are there description, tags, keywords, path,
    category, related and confidence (above ``sure``: points times ``bonus``). What of these stands
    in the file's name makes points, every word as often as it is named, and so does its extension
    where they name it. Files without a folder of ``least`` points have no row. Files of the same
    name, whatever its case, are scored once.
    """
    have = {c.lower() for c in folders.columns}
    f = folders.select(F.col("folder"), *(F.col(c) for c in ("description", "tags", "keywords", "path", "category", "related", "confidence") if c in have))
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    words = lambda c, at, longer: F.filter(F.split(text(c), at), lambda w: F.length(w) > longer)
    listed = lambda c: F.transform(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")), lambda w: F.lower(w))
    parts = {"name": F.array(text("folder")), "name_word": words("folder", r"[\s_-]+", 2)}
    parts |= {"description": words("description", r"[\s,.-]+", 3)} if "description" in have else {}
    parts |= {kind: listed(c) for kind, c in (("tag", "tags"), ("keyword", "keywords"), ("related", "related")) if c in have}
    parts |= {"path": words("path", r"[\\\\/]", 2)} if "path" in have else {}
    parts |= {"category": words("category", r"[\s_-]+", 2)} if "category" in have else {}
    named = lambda kind, n: lambda w: F.struct(w.alias("term"), F.lit(n).alias("points"), F.lit(kind).alias("kind"))
    told = f.select("folder", F.explode(F.concat(*(F.transform(c, named(kind, FOLDER_POINTS[kind])) for kind, c in parts.items()))).alias("t")).select("folder", "t.*").where("term <> ''")
    terms = told.groupBy("folder", "term").agg(F.sum("points").alias("points"))
    low = files.select("file", F.lower("name").alias("name"))
    once = low.select("name").distinct()
    names = once.select(F.col("name").alias("text_id"), F.col("name").alias("text"))
    hits = containing(names, terms.select(F.col("term").alias("term_id"), "term").distinct())
    by_name = hits.join(terms, hits["term_id"] == terms["term"]).groupBy("text_id", "folder").agg(F.sum("points").alias("points"))
    points = by_name.select(F.col("text_id").alias("name"), "folder", "points")
    ext = once.select("name", F.regexp_extract("name", r".\.([^.]*)$", 1).alias("ext")).where("ext <> ''")
    exts = ext.select("ext").distinct()
    marks = told.where(F.col("kind").isin("tag", "keyword")).select("folder", F.regexp_replace("term", r"^\.", "").alias("ext"), F.when(F.col("kind") == "tag", EXTENSION_POINTS["tag"]).otherwise(EXTENSION_POINTS["keyword"]).alias("points"))
    if "description" in have:
        in_text = containing(f.select(F.col("folder").alias("text_id"), text("description").alias("text")), exts.where(F.length("ext") > 1).select(F.col("ext").alias("term_id"), F.col("ext").alias("term")))
        marks = marks.unionByName(in_text.select(F.col("text_id").alias("folder"), F.col("term_id").alias("ext"), F.lit(EXTENSION_POINTS["description"]).alias("points")))
    by_ext = marks.groupBy("folder", "ext").agg(F.sum("points").alias("points"))
    points = points.unionByName(ext.join(by_ext, "ext").select("name", "folder", "points"))
    score = points.groupBy("name", "folder").agg(F.sum("points").cast("double").alias("score"))
    if "confidence" in have:
        surer = f.select("folder", F.when(F.col("confidence") > sure, bonus).otherwise(1.0).alias("_times")).groupBy("folder").agg(F.max("_times").alias("_times"))
        score = score.join(surer, "folder").select("name", "folder", (F.col("score") * F.col("_times")).alias("score"))
    score = score.where(F.col("score") >= least)
    if not all_scores:
        first = F.row_number().over(Window.partitionBy("name").orderBy(F.desc(F.round("score", 6)), "folder"))
        score = score.withColumn("_n", first).where("_n = 1")
    return low.join(score, "name").select("file", "folder", "score")


def rule_keywords(category: Column, name: Column, concepts: Column, most: int = 10) -> Column:
    """Words of the category, of the name without its extension, and concepts: distinct, in this order, of three characters or more."""
    words = lambda c: F.filter(F.split(canonical(c), " "), lambda w: F.length(w) > 2)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.slice(F.array_distinct(F.concat(words(category), words(stem), F.coalesce(concepts, F.array().cast("array<string>")))), 1, most)


def strategy_score(priority: list[Column], name: Column, path: str) -> Column:
    """0.3 for each priority field that is present, 0.4 if a word of the name is a literal part of the strategy's path; 1 at most."""
    literal = [w for part in path.split("/") if "{" not in part for w in part.lower().replace("-", " ").replace("_", " ").split()]
    present = sum((F.when(F.coalesce(F.trim(c), F.lit("")) != "", 0.3).otherwise(0.0) for c in priority), F.lit(0.0))
    words = F.filter(F.split(canonical(name), " "), lambda w: F.length(w) > 2)
    hit = F.exists(words, lambda w: w.isin(*literal)) if literal else F.lit(False)
    return F.least(F.lit(1.0), present + F.when(hit, 0.4).otherwise(0.0))


def best_strategy(files: DataFrame, group: str, strategies: dict[str, tuple[list[str], str]], *, name_col: str = "name", least: float = 0.3) -> DataFrame:
    """(group, strategy, score): the strategy (priority columns, path) with the best mean score above ``least``, the first named of equals.

    Where none is, ``adaptive`` with 0.75 and 0.005 a file, 0.15 of that at most.
    """
    means = files.groupBy(group).agg(F.count("*").alias("_n"), *(F.avg(strategy_score([F.col(c) for c in cols], F.col(name_col), path)).alias(k) for k, (cols, path) in strategies.items()))
    best = F.greatest(F.lit(0.0), F.lit(0.0), *(F.round(k, 9) for k in strategies))
    chosen = F.coalesce(*(F.when((F.round(k, 9) == best) & (best > least), k) for k in strategies), F.lit("adaptive"))
    return means.select(group, chosen.alias("strategy"), F.when(best > least, best).otherwise(0.75 + F.least(F.lit(0.15), 0.005 * F.col("_n"))).alias("score"))


def folder_cascade(files: DataFrame, near: DataFrame, modelled: DataFrame, folders: DataFrame, *, least: float = 0.65) -> DataFrame:
    """(file, folder, score, method): the nearest folder by vector, else a model's, else the one with most of a file's words.

    ``files``: (file, words: list), ``near``: (file, folder, cosine), ``modelled``: (file, folder, score),
    ``folders``: (folder, text). Words of three characters or more meet whole words of a folder's
    name and description; of equal counts the first folder by name.
    """
    w = files.select("file", F.explode(F.array_distinct(F.transform("words", lambda x: F.lower(x)))).alias("w")).where(F.length("w") > 2)
    f = folders.select("folder", F.explode(F.array_distinct(F.split(F.lower("text"), r"\W+"))).alias("w"))
    hits = w.join(f, "w").groupBy("file", "folder").agg(F.count("*").alias("n")).groupBy("file").agg(F.max("n").alias("n"), F.min_by("folder", F.struct((-F.col("n")).alias("c"), "folder")).alias("_word"))
    vector = near.where(F.col("cosine") >= least).groupBy("file").agg(F.max("cosine").alias("_c"), F.min_by("folder", F.struct((-F.col("cosine")).alias("c"), "folder")).alias("_vector"))
    model = modelled.where(F.col("folder").isNotNull()).groupBy("file").agg(F.max("score").alias("_s"), F.min_by("folder", F.struct((-F.col("score")).alias("c"), "folder")).alias("_model"))
    j = files.select("file").join(vector, "file", "left").join(model, "file", "left").join(hits, "file", "left")
    method = F.when(F.col("_vector").isNotNull(), "vector").when(F.col("_model").isNotNull(), "model").when(F.col("_word").isNotNull(), "words")
    return j.select("file", F.coalesce("_vector", "_model", "_word").alias("folder"), F.coalesce("_c", "_s", F.col("n").cast("double")).alias("score"), method.alias("method"))


def cluster_batches(files: DataFrame, members: DataFrame, named: DataFrame) -> DataFrame:
    """(file, cluster, folder, score, n): the batch's files with their cluster, its folder and its size in the batch.

    ``files``: (file), ``members``: (file, cluster), ``named``: (cluster, folder, score). Files in
    no cluster are a group of their own, without a folder. A group is rows, not a list in one.
    """
    j = files.select("file").distinct().join(members, "file", "left")
    n = j.groupBy("cluster").agg(F.count("*").alias("n"))  # a row a cluster
    facts = n.join(named, "cluster", "left").select(F.col("cluster").alias("_cluster"), "folder", "score", "n")
    return j.join(facts, F.col("cluster").eqNullSafe(F.col("_cluster"))).select("file", "cluster", "folder", "score", "n")


def adjusted_by_memory(suggestions: DataFrame, rules: DataFrame, memory: DataFrame | None = None, *, boost: float = 0.2, penalty: float = 0.1, most: float = 0.15) -> DataFrame:
    """``suggestions`` (file, folder, ext, score) with scores moved by what is remembered, within 0 to 1.

    ``rules``: (ext, folder), the rule of an extension: its folder gains ``boost``, others lose
    ``penalty``. ``memory``: (file, folder, score), a remembered placement that is like the file's:
    its folder gains its share ``most`` of the score, ``most`` at most, and others lose it. The
    strongest of several counts. Names are the same whatever their case.
    """
    same = lambda a, b: F.lower(a) == F.lower(b)
    key = F.regexp_replace(F.lower("ext"), r"^\.", "")
    r = rules.select(key.alias("_ext"), F.col("folder").alias("_rule"))
    s = suggestions.withColumn("_key", key).join(r, F.col("_key") == F.col("_ext"), "left")
    hit = F.max(F.when(same("folder", "_rule"), boost).when(F.col("_rule").isNotNull(), -penalty))
    miss = F.min(F.when(F.col("_rule").isNotNull() & ~same("folder", "_rule"), -penalty))
    change = F.when(hit > 0, hit + F.coalesce(miss, F.lit(0.0))).otherwise(F.coalesce(hit, F.lit(0.0)))
    out = s.groupBy("file", "folder", "ext", "score").agg(change.alias("_change"))
    if memory is not None:
        m = memory.groupBy("file", "folder").agg(F.max("score").alias("score")).select("file", F.col("folder").alias("_known"), F.least(F.lit(most), F.col("score") * most).alias("_by"))
        j = out.join(m, "file", "left").groupBy("file", "folder", "ext", "score", "_change")
        gain, loss = F.max(F.when(same("folder", "_known"), F.col("_by"))), F.max(F.when(~same("folder", "_known"), F.col("_by")))
        out = j.agg((F.coalesce(gain, F.lit(0.0)) - F.when(gain.isNull(), F.coalesce(loss, F.lit(0.0))).otherwise(0.0)).alias("_memory")).withColumn("_change", F.col("_change") + F.col("_memory"))
    return out.select("file", "folder", "ext", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + F.col("_change"))).alias("score"))


def pruned_patterns(patterns: DataFrame, now: float, *, capacity: int, stale_s: float = 180 * 86_400.0, share: float = 0.1, half_s: float = 30 * 86_400.0) -> DataFrame:
    """(key, reason) of patterns (key, count, confidence, last) that go: ``stale`` ones, then the ``low`` ones if ``capacity`` is still reached.

    ``last`` and ``now`` are seconds. The low ones are the ``share`` of the capacity with the least
    count times confidence over one plus the age in ``half_s``, equal scores by key.
    """
    stale = patterns.where(F.col("last") < now - stale_s)
    rest = patterns.where(F.col("last") >= now - stale_s)
    out = stale.select("key", F.lit("stale").alias("reason"))
    if rest.count() < capacity:
        return out
    score = F.round(F.col("count") * F.col("confidence") / (1 + (F.lit(now) - F.col("last")) / half_s), 9)
    return out.unionByName(rest.withColumn("_score", score).orderBy("_score", "key").limit(int(capacity * share)).select("key", F.lit("low").alias("reason")))


#: Words of names that tell a stage of work.
STAGES_OF_WORK = ("draft", "final", "review", "approved", "v1", "v2")


def batch_recommendations(groups: DataFrame) -> DataFrame:
    """(group, kind, confidence) for batches (group, project, has_dates, terms, folders): what to do with them.

    One project for all (0.9), dates (0.7), a term that tells a stage of work (0.8), more than five
    folders (0.6).
    """
    work = F.exists(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.lower(t).isin(*STAGES_OF_WORK))
    rules = (("project", 0.9, F.col("project").isNotNull()), ("temporal", 0.7, F.col("has_dates")), ("workflow", 0.8, work), ("groups", 0.6, F.col("folders") > 5))
    rows = F.array(*(F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(x).alias("confidence"))) for k, x, c in rules))
    return groups.select("group", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("group", "r.kind", "r.confidence")
