"""The analysis-history table: lookups, pages, counts, statistics, retention and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusloom.functions.text import json_text
from corpusloom.operators.folds import fold_in_order
from corpusloom.operators.ordered import STRETCH, over_last_rows, over_last_stretch
from corpusloom.session import table


def history(spark, sf_dir: str) -> DataFrame:
    """Documents in the role of analysed files; every derived column follows from the row itself."""
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "docx", "csv", "png", "txt"))), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.col("source").alias("category"), ext.alias("ext"), name.alias("file_name"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"),
        F.col("n_chars").alias("size"), ((F.col("doc_id") * 37) % 101).alias("confidence"), (F.lit(1704067200) + F.col("doc_id") * 3600).cast("long").alias("ts"),
        F.array("lang", F.concat(F.lit("tag"), (F.col("doc_id") % 7).cast("string"))).alias("tags"), ((F.col("doc_id") * 13) % 500).alias("ms"), "text",
    )


def month_of(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a result with the result's size and whether more follows; the size is a scalar subquery."""
    total = df.select(F.count("*")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total).withColumn("has_more", F.col("total") > offset + limit)


def lookup(df: DataFrame, path: str) -> DataFrame:
    """By exact path, else by the path with back slashes and doubled slashes made plain."""
    plain = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "/+", "/")
    wanted = path.replace("\\", "/")
    while "//" in wanted:
        wanted = wanted.replace("//", "/")
    hit = df.where((F.col("path") == path) | (plain == wanted))
    return hit.orderBy((F.col("path") == path).desc(), "doc_id").limit(1)


def lookup_hashes(df: DataFrame, hashes: DataFrame, content: Column, *, ts_col: str = "ts", id_col: str = "doc_id") -> DataFrame:
    """The newest row with each content hash asked for (hash), of equals that with the largest id."""
    hits = df.withColumn("hash", content).join(hashes.select("hash").distinct(), "hash", "left_semi")
    return latest_per_key(hits, "hash", F.desc_nulls_last(ts_col), F.desc(id_col))


def upsert_report(old: DataFrame, new: DataFrame, key: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """The table after an upsert of the ``valid`` rows, and (key, outcome) of every new row: inserted, updated or invalid."""
    good = F.coalesce(valid, F.lit(False))
    known = old.select(F.col(key).alias("_key")).distinct().withColumn("_known", F.lit(True))
    told = new.select(F.col(key), good.alias("_good")).join(known, F.col(key) == F.col("_key"), "left")
    outcome = F.when(~F.col("_good"), "invalid").when(F.col("_known"), "updated").otherwise("inserted")
    return upsert(old, new.where(good), key), told.select(key, outcome.alias("outcome"))


#: The columns of an export.
EXPORTED = ("fileName", "originalPath", "category", "confidence", "keywords", "subject", "timestamp")


def exported(entries: DataFrame, form: str) -> DataFrame:
    """``entries`` with a ``line`` of an export: json, or csv with every cell as a JSON string and lists joined by ``; ``.

    Nulls are empty cells in csv and left out in json; EXPORTED names the columns of a csv's first line.
    """
    stamp = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    cells = dict(zip(EXPORTED, (F.col("file_name"), F.col("path"), F.col("category"), F.col("confidence"), F.col("tags"), F.col("subject"), stamp), strict=True))
    if form == "json":
        return entries.withColumn("line", F.to_json(F.struct(*(c.alias(n) for n, c in cells.items()))))
    cells["keywords"] = F.array_join("tags", "; ")
    return entries.withColumn("line", F.concat_ws(",", *(json_text(c.cast("string")) for c in cells.values())))


def size_range(size: Column) -> Column:
    kb = 1024
    return F.when(size < kb, "tiny").when(size < kb**2, "small").when(size < 10 * kb**2, "medium").when(size < 100 * kb**2, "large").otherwise("huge")


def latest_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key; Spark keeps one row a key and task before it shuffles."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def most_frequent(df: DataFrame, group: str, value: str, seen: str) -> DataFrame:
    """The most frequent non-empty value of each group; of equals the one seen first."""
    counts = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(group, value).agg(F.count("*").alias("n"), F.min(seen).alias("first"))
    return latest_per_key(counts, group, F.desc("n"), F.asc("first")).select(group, value, "n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def shares(df: DataFrame, by: str, when: dict[str, Column]) -> DataFrame:
    return df.groupBy(by).agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in when.items()))


def common_tags(members: DataFrame, group: str, *, id_col: str, tags_col: str = "tags", share: float = 0.4, least: int = 2) -> DataFrame:
    """(group, tag, n, rank): tags of at least ``share`` of a group's members, the most frequent first.

    Tags are the same whatever their case and shown in the form seen first (by id); numbers
    and tags under ``least`` characters say nothing.
    """
    n = members.groupBy(group).agg(F.count("*").alias("total"))
    rows = members.select(group, F.col(id_col).alias("_id"), F.posexplode(tags_col).alias("_at", "_tag")).withColumn("_form", F.lower(F.trim("_tag")))
    rows = rows.where((F.length("_form") >= least) & ~F.col("_form").rlike("^[0-9]+$"))
    t = rows.groupBy(group, "_form").agg(F.count("*").alias("n"), F.min_by(F.trim("_tag"), F.struct("_id", "_at")).alias("tag"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "_form"))
    return t.join(n, group).where(F.col("n") >= F.ceil(F.lit(share) * F.col("total"))).select(group, "tag", "n", rank.alias("rank"))


def file_patterns(files: DataFrame, group: str, *, share: float = 0.3) -> DataFrame:
    """One row per group of files (group, id, name, ext, project, category, date): what they have in common.

    project: the only one, else null; first_date, last_date and their description; types in
    order; the most frequent category (of equals the first seen); words of more than three
    characters that stand in more than ``share`` of the names.
    """
    total = files.groupBy(group).agg(F.count("*").alias("_n"), F.count_distinct("project").alias("_p"), F.min("project").alias("_project"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.array_sort(F.collect_set("ext")).alias("types"))
    best = most_frequent(files, group, "category", "id").select(group, "category")
    words = files.select(group, F.explode(F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: F.length(w) > 3)).alias("w")).groupBy(group, "w").agg(F.count("*").alias("c"))
    terms = words.join(total.select(group, "_n"), group).where(F.col("c") > share * F.col("_n")).groupBy(group).agg(F.array_sort(F.collect_list("w")).alias("terms"))
    span = F.when(F.col("first_date") == F.col("last_date"), F.concat(F.lit("Single date: "), "first_date")).otherwise(F.concat_ws(" to ", "first_date", "last_date"))
    j = total.join(best, group, "left").join(terms, group, "left")
    none = F.array().cast("array<string>")
    return j.select(group, F.when(F.col("_p") == 1, F.col("_project")).alias("project"), "first_date", "last_date", F.when(F.col("first_date").isNotNull(), span).alias("dates"), "types", "category", F.coalesce("terms", none).alias("terms"))


def service_health(calls: DataFrame, by: str, *, ms: str = "ms", failed: str = "failed", tokens: str = "tokens") -> DataFrame:
    """(by, calls, avg_ms, error_rate, tokens_per_s, score): 100 less 30 for errors, less up to 20 for a mean above 100 ms."""
    n, mean = F.count("*"), F.avg(ms)
    errors = F.count_if(F.col(failed)) / n
    late = F.when(mean > 100, F.least(F.lit(20.0), (mean - 100) / 10)).otherwise(0.0)
    speed = F.coalesce(F.sum(tokens) / F.nullif(F.sum(ms), F.lit(0)) * 1000, F.lit(0.0))
    return calls.groupBy(by).agg(n.alias("calls"), mean.alias("avg_ms"), errors.alias("error_rate"), speed.alias("tokens_per_s"), F.greatest(F.lit(0.0), F.round(100 - errors * 30 - late)).alias("score"))


def degradation(outcomes: DataFrame, *, window: int = 200, least: int = 20, fallback_rate: float = 0.5, error_rate: float = 0.25, stretch: int = STRETCH) -> DataFrame:
    """``outcomes`` (pipeline, id, s, outcome) with n, fallbacks, errors over the last ``window`` and whether that is degraded.

    outcome: primary, fallback, anything else is an error; ``s`` are seconds. A pipeline's history
    is worked on in stretches of ``stretch`` rows, so one that has most events is many tasks.
    """
    kind = F.coalesce(F.col("outcome"), F.lit(""))

    def counts(w: WindowSpec) -> dict[str, Column]:
        of = lambda c: F.sum(c.cast("int")).over(w).cast("long")
        return {"n": F.count("*").over(w), "fallbacks": of(kind == "fallback"), "errors": of(~kind.isin("primary", "fallback"))}

    r = over_last_rows(outcomes, "pipeline", ["s", "id"], window - 1, counts, stretch=stretch)
    return r.withColumn("degraded", (F.col("n") >= least) & ((F.col("fallbacks") >= fallback_rate * F.col("n")) | (F.col("errors") >= error_rate * F.col("n"))))


def rate_limited(calls: DataFrame, most: int, window_s: float, *, key: str = "key") -> DataFrame:
    """``calls`` (key, s, ...) with the calls ``n`` of a key in the last ``window_s`` seconds, this one included, and whether it is ``allowed``."""
    r = over_last_stretch(calls, key, "s", window_s, lambda w: {"n": F.count("*").over(w)})
    return r.withColumn("allowed", F.col("n") <= most)


def degradation_alerts(degraded: DataFrame, quiet_s: float = 30.0) -> DataFrame:
    """(pipeline, id): of the degraded rows those that alert, at most one in ``quiet_s``."""

    def step(last, s, row):
        return (s, [(row,)]) if last is None or s - last >= quiet_s else (last, [])

    return fold_in_order(degraded.where("degraded"), "pipeline", ["s", "id"], ["s", "id"], "pipeline string, id long", start=lambda: None, step=step, finish=lambda _: [])


def update_by_key(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``old`` with the columns that ``changes`` (key, some of its columns) has; a null there changes nothing. One change a key."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in names))
    return old.join(new, key, "left").select(*(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in old.columns))


def move_paths(tables: dict[str, tuple[DataFrame, str]], moves: DataFrame) -> dict[str, DataFrame]:
    """All tables, each given with the name of its path column, after the same moves (old_path, new_path).

    A moved folder takes along what is under it. A path follows its longest moved ancestor, found
    by equal ancestors, and every table is changed by the one set of moves or none is.
    """
    once = moves.groupBy("old_path").agg(F.max("new_path").alias("new_path"))

    def moved(df: DataFrame, path: str) -> DataFrame:
        hits = df.select(F.col(path).alias("_path")).distinct().select("_path", F.explode(F.transform(F.split("_path", "/"), lambda _, i: F.array_join(F.slice(F.split("_path", "/"), 1, i + 1), "/"))).alias("old_path")).join(once, "old_path")
        best = hits.groupBy("_path").agg(F.max_by(F.struct("old_path", "new_path"), F.length("old_path")).alias("_m"))
        new = F.concat(F.col("_m.new_path"), F.col(path).substr(F.length("_m.old_path") + 1, F.length(path)))
        return df.join(best, F.col(path) == F.col("_path"), "left").select(*(F.coalesce(new, F.col(path)).alias(path) if c == path else F.col(c) for c in df.columns))

    return {name: moved(df, path) for name, (df, path) in tables.items()}


def ready_queue(analyses: DataFrame, *, limit: int = 1_000, cap: int = 2_000) -> DataFrame:
    """The newest ready analyses (id, state, ts); a caller may ask for ``cap`` at most."""
    return analyses.where(F.col("state") == "ready").orderBy(F.desc("ts"), F.desc("id")).limit(max(1, min(limit, cap)))


def duplicate_groups(files: DataFrame, *, id_col: str, content: Column, checksum=lambda c: F.sha2(c, 256)) -> DataFrame:
    """(content_hash, n, first_id) of equal contents; the checksum is the caller's."""
    rows = files.select(F.col(id_col).alias("_id"), content.alias("_c"), F.octet_length(content).alias("_size"))
    return rows.groupBy("_size", checksum(F.col("_c")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("_id").alias("first_id")).where("n > 1").select("content_hash", "n", "first_id")
