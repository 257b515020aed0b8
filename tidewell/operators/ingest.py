"""Idempotent loading and set-based mutations; a target table goes in and its new state comes out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewell.session import materialise, numbered


@dataclass
class Inserted:
    """New rows to append, and counts of rows inserted and skipped."""

    rows: DataFrame
    inserted: int
    skipped: int


def first_of(batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return batch.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def insert_absent(batch: DataFrame, target: DataFrame, keys: list[str], order: list[Column] | None = None) -> Inserted:
    """Rows of ``batch`` whose key ``target`` lacks, one a key (the first in ``order``, default all columns).

    Rows with a null in the key do not conflict with anything and are refused, as a primary key would.
    """
    present = batch.na.drop(subset=keys)
    fresh = first_of(present, keys, order or [F.col(c) for c in batch.columns]).join(target.select(*keys), keys, "left_anti").select(*batch.columns)
    fresh = materialise(fresh, "inserted")
    n, total = fresh.count(), batch.count()
    return Inserted(fresh, n, total - n)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """``target`` with each key's row replaced by that of ``batch``; of several the one with the largest ``newest``."""
    rows = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return first_of(rows, keys, [F.col("_new").desc(), newest.desc_nulls_last()]).drop("_new")


def advance(target: DataFrame, batch: DataFrame, keys: list[str], mark: list[str]) -> DataFrame:
    """High-water marks: the larger ``mark`` (columns in order) of each key survives; marks never go back."""
    both = target.select(*keys, *mark).unionByName(batch.select(*keys, *mark))
    return both.groupBy(*keys).agg(F.max(F.struct(*mark)).alias("_m")).select(*keys, *(F.col(f"_m.{c}").alias(c) for c in mark))


def replace_children(target: DataFrame, batch: DataFrame, parents: list[str]) -> DataFrame:
    """All rows of the parents in ``batch`` replaced by its rows."""
    return target.join(batch.select(*parents).distinct(), parents, "left_anti").unionByName(batch)


def update_from(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], only_null: bool = False) -> DataFrame:
    """``columns`` set from ``changes`` (one row a key); with ``only_null`` just where the target has null."""
    c = changes.select(*keys, *(F.col(x).alias(f"_{x}") for x in columns), F.lit(True).alias("_hit"))
    rows = target.join(c, keys, "left")
    new = lambda x: F.coalesce(x, f"_{x}") if only_null else F.when(F.col("_hit"), F.col(f"_{x}")).otherwise(F.col(x))
    return rows.select(*(new(x).alias(x) if x in columns else F.col(x) for x in target.columns))


def remap_duplicates(parents: DataFrame, children: DataFrame, name: str, id_: str, fk: str) -> tuple[DataFrame, DataFrame]:
    """Parents with one row a name (the smallest id) and children that point at the survivors, repeats dropped."""
    low = parents.withColumn("_keep", F.min(id_).over(Window.partitionBy(name)))
    map_ = low.select(F.col(id_).alias("_old"), "_keep")
    moved = children.join(map_, F.col(fk) == F.col("_old"), "left").withColumn(fk, F.coalesce("_keep", fk)).drop("_old", "_keep").distinct()
    return low.filter(F.col(id_) == F.col("_keep")).drop("_keep"), moved


def remap_ids(rows: DataFrame, source: DataFrame, target: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Rows with ``id_`` translated through the natural key; rows without a counterpart are dropped."""
    pairs = source.select(F.col("id").alias("_old"), *keys).join(target.select(F.col("id").alias("_new"), *keys), keys)
    return rows.join(pairs.select("_old", "_new"), F.col(id_) == F.col("_old")).withColumn(id_, F.col("_new")).drop("_old", "_new")


def check_remap(before: DataFrame, after: DataFrame, children: DataFrame, id_: str, fk: str) -> dict[str, int]:
    """What a rewrite of ids must leave at zero: lost rows, colliding ids, children without a parent."""
    a = after.agg(F.count("*").alias("n"), F.countDistinct(id_).alias("d")).first()
    return {"lost": before.count() - a["n"], "collisions": a["n"] - a["d"], "unreferenced": children.join(after, F.col(fk) == after[id_], "left_anti").count()}


def link_posts(bridge: DataFrame, registry: DataFrame, batch_keys: DataFrame, job_id: int) -> DataFrame:
    """New bridge rows ``(scrape_job_id, post_id)`` for the keys of a batch; key2 compares as '' where there is one key."""
    keys = ["platform", "key1", "key2"]
    b = batch_keys.select("platform", "key1", F.coalesce("key2", F.lit("")).alias("key2")).distinct()
    rows = registry.join(b, keys).select(F.lit(job_id).cast("long").alias("scrape_job_id"), F.col("id").alias("post_id"))
    return rows.join(bridge, ["scrape_job_id", "post_id"], "left_anti")


def get_or_create(jobs: DataFrame, name: str, description: str | None = None) -> tuple[DataFrame, int]:
    """``(jobs, id)`` with a row for ``name``, appended under the next id if there was none."""
    row = jobs.filter(F.col("name") == name).agg(F.min("id")).first()[0]
    if row is not None:
        return jobs, row
    top = (jobs.agg(F.max("id")).first()[0] or 0) + 1
    new = jobs.sparkSession.range(1).select(F.lit(top).cast("long").alias("id"), F.lit(name).alias("name"), F.lit(description).cast("string").alias("description"))
    return jobs.unionByName(new, allowMissingColumns=True), top


def quarantine(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` by a validity predicate; an unknown outcome is bad."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def rejected(rows: DataFrame, insert) -> DataFrame:
    """Rows that ``insert`` refuses, with the ``error`` it raised; all others are inserted.

    ``insert(record batch)`` runs on the executors, writes a batch whole or raises, and must bear being called again with
    the same rows (a lost task is run again). A batch that fails is halved until the rows at fault stand alone.
    """
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        def tried(batch) -> list:
            try:
                insert(batch)
                return []
            except Exception as e:
                if batch.num_rows == 1:
                    return [(batch, f"{type(e).__name__}: {e}")]
            half = batch.num_rows // 2
            return tried(batch.slice(0, half)) + tried(batch.slice(half))

        for batch in batches:
            for bad, error in tried(batch) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([*bad.columns, pa.array([error])], [*names, "error"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "error string"]))


def json_wrapped(rows: DataFrame) -> DataFrame:
    """Structs, maps and arrays as JSON text, for targets that store such values in JSON columns."""
    nested = (T.StructType, T.MapType, T.ArrayType)
    return rows.select(*(F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in rows.schema))


def fetch_states(states: DataFrame, answers: DataFrame, longest_error: int = 2000) -> DataFrame:
    """Conditional-fetch state after a round of answers ``(id, etag, last_modified, http_status, error, at)``.

    Validators that an answer lacks stay as they were (an answer of "not modified" may leave them out), errors are cut to
    ``longest_error`` characters, and of several answers of an id the latest counts.
    """
    last = first_of(answers, ["id"], [F.col("at").desc_nulls_last()]).select("id", *(F.col(c).alias(f"_{c}") for c in ("etag", "last_modified", "http_status", "error", "at")), F.lit(True).alias("_hit"))
    rows = states.join(last, "id", "left")
    kept = lambda c: F.coalesce(F.nullif(f"_{c}", F.lit("")), c).alias(c)
    new = lambda value, c: F.when(F.col("_hit"), value).otherwise(F.col(c)).alias(c)
    return rows.select("id", kept("etag"), kept("last_modified"), new(F.col("_at"), "last_fetch_ts"), new(F.col("_http_status"), "last_http_status"), new(F.substring("_error", 1, longest_error), "last_error"))


def align(rows: DataFrame, target: DataFrame, required: list[str] = ()) -> DataFrame:
    """Columns that both have, in the target's order; a missing required column raises ValueError."""
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(*(c for c in target.columns if c in rows.columns))


def load_tree(nodes: DataFrame, id_: str, parent: str, present: DataFrame | None = None, passes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(loaded, waiting)``: nodes whose ancestors are all there, and those that have to wait.

    ``loaded`` adds ``pass``, the place of a node below its root (1; children of what is ``present`` already: 2). ``waiting``
    adds ``reason`` (``orphan``: some ancestor is missing; ``circle``; ``deep``: beyond ``passes``; ``no id``) and ``circle``, the
    smallest id on the circle that a node is on or below. A later call with ``present`` set to what is loaded goes on with
    what waits. Of rows with the same id that with the smallest parent counts (none before any) and all share its place.

    Every node points to an ancestor, and in each round to the one that this one points to, so that a tree of depth d
    takes about log d joins; who points at nothing any more is done. A pointer that has gone as many steps as there are
    nodes without an end is on a circle.

    Both sides of every join grow with the nodes, so all are merged: Spark would judge tables of ids by their packed
    files, and send along what is many times larger in memory.
    """
    extra = ["pass", "reason", "circle"]
    nodes = materialise(nodes.drop(*extra), "nodes")
    first = F.min(F.struct(F.col(parent).isNotNull().alias("child"), F.col(parent).alias("up")))["up"]
    own = nodes.filter(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("id")).agg(first.alias("up"))
    known = own.select(F.col("id").alias("up"), F.lit(False).alias("_before"))
    if present is not None:
        known = known.unionByName(present.select(F.col(present.columns[0] if id_ not in present.columns else id_).alias("up"), F.lit(True).alias("_before")))
    known = known.filter("up IS NOT NULL").groupBy("up").agg(F.max("_before").alias("_before"))
    status = F.when(F.col("up").isNull() | F.coalesce("_before", F.lit(False)), "loaded").when(F.col("_before").isNull(), "orphan")
    hops = F.when(F.col("_before"), 2).otherwise(1).cast("long")
    start = own.join(known.hint("merge"), "up", "left").select("id", status.alias("status"), hops.alias("hops"), F.col("id").alias("low"), "up")
    at = materialise(start.withColumn("up", F.when(F.col("status").isNull(), F.col("up"))), "pointers")

    reach, n = 1, at.count()
    while reach <= n and at.filter("up IS NOT NULL").head(1):
        to = at.select(F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("hops").alias("_hops"), F.col("low").alias("_low"), F.col("up").alias("_up"))
        moved = at.filter("up IS NOT NULL").join(to.hint("merge"), F.col("up") == F.col("_id"))
        moved = moved.select("id", F.col("_status").alias("status"), (F.col("hops") + F.col("_hops")).alias("hops"), F.least("low", "_low").alias("low"), F.col("_up").alias("up"))
        at = materialise(at.filter("up IS NULL").unionByName(moved), "pointers")
        reach *= 2

    # who still points somewhere points at the node of a circle, whose low is the least of the whole circle
    circles = at.filter("up IS NOT NULL").select(F.col("up").alias("_on")).distinct()
    circles = circles.join(at.hint("merge"), F.col("_on") == F.col("id")).select("_on", F.col("low").alias("circle"))
    placed = at.join(circles.hint("merge"), F.col("up") == F.col("_on"), "left").select(F.col("id").alias("_id"), "status", "hops", "circle")
    out = nodes.join(placed.hint("merge"), F.col(id_) == F.col("_id"), "left")
    deep = F.lit(False) if passes is None else F.col("hops") > passes
    ready = F.coalesce((F.col("status") == "loaded") & ~deep, F.lit(False))
    reason = F.when(F.col("_id").isNull(), "no id").when(F.col("circle").isNotNull(), "circle").when(F.col("status") == "orphan", "orphan").otherwise("deep")
    loaded = out.filter(ready).select(*nodes.columns, F.col("hops").cast("int").alias("pass"))
    return loaded, out.filter(~ready).select(*nodes.columns, reason.alias("reason"), "circle")


def merge_term_state(state: DataFrame, terms: DataFrame, as_of: str, back_seconds: int = 60) -> DataFrame:
    """Schedule state against the list of terms: gone terms drop out, marks only advance, new terms queue one by one."""
    now = F.lit(as_of).cast("timestamp")
    kept = state.join(terms.select("term_id", F.col("name").alias("_name"), F.col("last_found_ts").alias("_ts")), "term_id").select("term_id", F.col("_name").alias("name"), F.greatest("last_seen", "_ts").alias("last_seen"), "rate", "next_run_at")
    fresh = numbered(terms.join(state, "term_id", "left_anti"), ["term_id"], "_k")
    wait = (F.col("_k") * back_seconds).cast("int")
    return kept.unionByName(fresh.select("term_id", "name", F.col("last_found_ts").alias("last_seen"), F.lit(0.0).alias("rate"), (now + F.make_dt_interval(secs=wait)).alias("next_run_at")))
