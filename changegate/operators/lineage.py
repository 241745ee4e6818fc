"""Catalog resolution, downstream reach, enrichment and page checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegate.constants import ADDITIVE_TYPES
from changegate.functions.text import assertion_fields, asset_type, dataset_name, type_fingerprint, valid_urn
from changegate.operators.skew import even_join
from changegate.session import STAGE_CODEC, cut_lineage, fresh_path, remove, short_shuffles

CHANGE_KEY = ["run_key", "change_id"]
# Join keys of the column match: no column stated, and any column.
NO_COLUMN = ""
ANY_COLUMN = "*"


def resolve_dataset(changes: DataFrame, catalog: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Source dataset of each change and whether it is the only exact match.

    The catalog is counted per name before the join, so a name carried by many
    datasets joins as one row.  ``candidates`` (relation, urn) replaces the
    default near matches, which are the datasets with the same last name part.
    """
    named = catalog.select("urn", F.lower(dataset_name(F.col("urn"))).alias("full_name")).filter(
        F.col("full_name").isNotNull()
    )
    exact = named.groupBy("full_name").agg(
        F.count_distinct("urn").alias("n_exact"), F.min("urn").alias("exact_urn")
    )
    normal = F.lower(F.replace(F.col("relation"), F.lit('"'), F.lit("")))
    out = even_join(changes.withColumn("full_name", normal), exact, ["full_name"], "left")
    if candidates is None:
        near = named.groupBy(F.element_at(F.split("full_name", r"\."), -1).alias("near_key")).agg(
            F.count(F.lit(1)).alias("n_near")
        )
        out = out.withColumn("near_key", F.element_at(F.split("full_name", r"\."), -1))
    else:
        near = candidates.groupBy(F.col("relation").alias("near_key")).agg(F.count(F.lit(1)).alias("n_near"))
        out = out.withColumn("near_key", F.col("relation"))
    out = even_join(out, near, ["near_key"], "left")

    direct = F.col("relation").startswith("urn:li:dataset:")
    direct_ok = direct & dataset_name(F.col("relation")).isNotNull()
    n_exact = F.coalesce("n_exact", F.lit(0))
    known = F.when(direct, direct_ok).otherwise(n_exact == 1)
    near_any = direct | (F.coalesce("n_near", F.lit(0)) + n_exact > 0)
    status = F.when(known, "complete").when(near_any, "ambiguous").otherwise("missing")
    return (
        out.withColumn("source_urn", F.when(direct_ok, F.col("relation")).when(known, F.col("exact_urn")))
        .withColumn("catalog_status", status)
        .withColumn("catalog_reason", F.when(~known, F.concat(F.lit("catalog.dataset_"), status)))
        .drop("full_name", "near_key", "n_exact", "exact_urn", "n_near")
    )


def changed_column() -> Column:
    """Column a change is checked under: the new one for additions, else the old one."""
    return F.when(F.col("change_type").isin(*ADDITIVE_TYPES), F.col("new_column")).otherwise(
        F.coalesce("old_column", "new_column")
    )


def check_baseline(resolved: DataFrame, fields: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Does the catalog still show the state the change started from?

    ``listing`` (urn, exhausted) says whether a dataset's field list was read to
    its end; without it the whole field table was read, so absence is proven.
    """
    one = fields.groupBy(
        F.col("urn").alias("source_urn"), F.lower("field_path").alias("field_key")
    ).agg(F.count(F.lit(1)).alias("n_match"), F.max("native_type").alias("native_type"))
    per_dataset = one.groupBy("source_urn").agg(F.sum("n_match").alias("n_fields"))
    named = resolved.withColumn("checked_column", changed_column()).withColumn("field_key", F.lower("checked_column"))
    out = even_join(even_join(named, one, ["source_urn", "field_key"], "left"), per_dataset, ["source_urn"], "left")
    exhausted = F.lit(True)
    if listing is not None:
        read = listing.groupBy(F.col("urn").alias("source_urn")).agg(F.bool_and("exhausted").alias("exhausted"))
        out = even_join(out, read, ["source_urn"], "left")
        exhausted = F.coalesce("exhausted", F.lit(False))

    n_match = F.coalesce("n_match", F.lit(0))
    adds = F.col("change_type").isin(*ADDITIVE_TYPES)
    fresh = type_fingerprint(F.col("native_type")) == type_fingerprint(F.col("old_type"))
    reason = (
        F.when(F.col("source_urn").isNull(), F.col("catalog_reason"))
        .when(F.col("checked_column").isNull(), "catalog.change_column_missing")
        .when(adds & (n_match > 0), "catalog.addition_column_exists")
        .when(adds & ~exhausted, "catalog.schema_truncated")
        .when(adds, F.lit(None))
        .when((n_match != 1) & (F.coalesce("n_fields", F.lit(0)) > 0), "catalog.column_stale")
        .when(n_match != 1, "catalog.column_missing")
        .when(F.col("old_type").isNull(), F.lit(None))
        .when(F.col("native_type").isNull(), "catalog.type_fingerprint_missing")
        .when(~fresh, "catalog.type_fingerprint_stale")
    )
    status = (
        F.when(F.col("source_urn").isNull(), F.col("catalog_status"))
        .when(F.col("reason").isNull(), "complete")
        .when(F.col("reason") == "catalog.schema_truncated", "truncated")
        .when(F.col("reason").isin("catalog.addition_column_exists", "catalog.column_stale"), "stale")
        .when(F.col("reason") == "catalog.type_fingerprint_stale", "stale")
        .otherwise("missing")
    )
    drop = ["field_key", "n_match", "native_type", "n_fields", "exhausted", "catalog_reason", "reason"]
    return (
        out.withColumn("reason", reason)
        .withColumn("catalog_status", status)
        .withColumn("new_reason", F.col("reason"))
        .drop(*drop)
        .withColumnRenamed("new_reason", "catalog_reason")
    )


@dataclass(frozen=True)
class Reach:
    """What was reached, the sources whose trace a bound on the hops cut off, and the folder of the trace."""

    rows: DataFrame
    truncated: DataFrame
    folder: str = ""


def _trace(
    start: DataFrame,
    expand: Callable[[DataFrame], DataFrame],
    source: list[str],
    max_hops: int | None,
    again: Callable[[int], bool | None] = lambda hop: True,
) -> Reach:
    """Breadth-first trace of all sources together, to the end or to ``max_hops``.

    Every hop is written to a folder of its own.  The next one starts from a frontier of known size and leaves out all
    earlier hops with one anti join against the whole folder, so the plan of a hop does not grow with its number, and a lost
    executor costs one hop.  ``again`` says whether rows of a hop may have been met before, which alone needs that join, or None
    if there are none.
    """
    spark, item = start.sparkSession, start.columns
    folder = fresh_path(spark, "reach")

    def write(rows: DataFrame, hop: int) -> None:
        with short_shuffles(spark):
            rows.write.parquet(f"{folder}/hop_count={hop}", compression=STAGE_CODEC)

    write(start.distinct(), 0)
    hop, open_sources = 0, None
    while True:
        frontier = spark.read.schema(start.schema).parquet(f"{folder}/hop_count={hop}")
        if (hop and frontier.isEmpty()) or (met := again(hop + 1)) is None:
            break
        step = expand(frontier).select(*item).distinct()
        if met:
            visited = spark.read.schema(start.schema).parquet(*[f"{folder}/hop_count={h}" for h in range(hop + 1)])
            step = step.join(visited, item, "left_anti")
        if hop == max_hops:
            open_sources = step.select(*source).distinct()
            break
        hop += 1
        write(step, hop)
    rows = spark.read.schema(f"{_ddl(start)}, hop_count int").parquet(folder).filter("hop_count > 0")
    return Reach(rows, start.select(*source).filter(F.lit(False)) if open_sources is None else open_sources, folder)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def _numbered(urns: DataFrame) -> DataFrame:
    """(id, urn) of all distinct urns, written once; ids are in the order of the urns, so the smallest id is the smallest urn."""
    known = urns.filter(F.col("urn").isNotNull()).distinct()
    return cut_lineage(known.orderBy("urn").select(F.monotonically_increasing_id().alias("id"), "urn"))


def _hashed(urn: str) -> Column:
    """A number for a urn that needs no join; two urns may share one, which its user has to rule out."""
    return F.when(F.col(urn).isNotNull(), F.xxhash64(urn))


def _mark(column: str) -> Column:
    """One of 64 bits for a column name: where a dataset's bits lack it, the column is not among those they were made of."""
    return F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`), 64) as int))")


def _named(names: DataFrame, node: str, urn: str) -> DataFrame:
    return names.select(F.col("id").alias(node), F.col("urn").alias(urn))


SOURCES_A_PART = 1 << 13  # sources traced together where the rows of each are folded


class AssetReach:
    """What was reached below sources, traced on first use by numbers instead of names, which keeps every hop's rows small.

    ``ids``: source, node, hop_count, numbered by ``names`` (id, urn) in the order of the urns; ``rows``: the same by name;
    ``truncated``: the sources that a bound on the hops cuts off.
    """

    def __init__(self, sources: DataFrame, edges: DataFrame, max_hops: int | None):
        self._max_hops = max_hops
        with short_shuffles(edges.sparkSession):
            edges = cut_lineage(edges.select("src_urn", "dst_urn"))
            ends = edges.select(F.explode(F.array("src_urn", "dst_urn")).alias("urn"))
            self.names = _numbered(ends.unionByName(sources.select(F.col("source_urn").alias("urn"))))
            numbered = edges.join(_named(self.names, "node", "src_urn"), "src_urn")
            self._links = cut_lineage(numbered.join(_named(self.names, "dst", "dst_urn"), "dst_urn", "left").select("node", "dst"))
            starts = sources.select("source_urn").distinct().join(_named(self.names, "source", "source_urn"), "source_urn")
            self._start = cut_lineage(starts.select("source", F.col("source").alias("node")))
        self._layers: list[DataFrame] = []
        self._layered = True

    def _expand(self, frontier: DataFrame) -> DataFrame:
        return frontier.join(self._links, "node").select("source", F.col("dst").alias("node"))

    def _again(self, hop: int) -> bool | None:
        """Whether a hop may reach what an earlier one did, found by nodes alone, which are few beside the rows of all sources.

        A layer holds the nodes at the end of all paths of so many edges.  Until one shares a node with an earlier layer, no row
        can come again; from there on any may, and no more layers are made, so that together they hold each node about once.
        """
        while self._layered and len(self._layers) <= hop:
            with short_shuffles(self._links.sparkSession):
                if not self._layers:
                    self._layers.append(cut_lineage(self._start.select("node").distinct()))
                    continue
                layer = cut_lineage(self._layers[-1].join(self._links, "node").select(F.col("dst").alias("node")).distinct())
                seen = reduce(DataFrame.unionByName, self._layers)
                self._layered = layer.join(seen, "node", "left_semi").isEmpty()
                self._layers.append(layer)
        if hop >= len(self._layers) or (not self._layered and hop == len(self._layers) - 1):
            return True
        return None if self._layers[hop].isEmpty() else False

    def _trace(self, start: DataFrame) -> Reach:
        return _trace(start, self._expand, ["source"], self._max_hops, self._again)

    @cached_property
    def _traced(self) -> Reach:
        return self._trace(self._start)

    def folded(self, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``fold`` of ``ids``, for one that keeps sources apart, such as a count for each.

        The sources are traced in parts of about ``SOURCES_A_PART``, one after another, and the rows of a part are removed once
        folded, so that the disk holds those of one part however many sources there are.
        """
        spark = self._start.sparkSession
        path, parts = fresh_path(spark, "folded"), -(-self._start.count() // SOURCES_A_PART) or 1
        for part in range(parts):
            found = self._trace(self._start.filter(F.pmod(F.xxhash64("source"), F.lit(parts)) == part))
            result = fold(found.rows)
            with short_shuffles(spark):
                result.write.mode("append").parquet(path, compression=STAGE_CODEC)
            remove(spark, found.folder)
        return spark.read.schema(result.schema).parquet(path)

    @property
    def ids(self) -> DataFrame:
        return self._traced.rows

    @property
    def rows(self) -> DataFrame:
        named = self.ids.join(_named(self.names, "source", "source_urn"), "source").join(_named(self.names, "node", "urn"), "node", "left")
        return named.select("source_urn", "urn", "hop_count")

    @property
    def truncated(self) -> DataFrame:
        if "_traced" in self.__dict__ or self._max_hops is None:
            cut = self._traced.truncated if "_traced" in self.__dict__ else self._start.select("source").filter(F.lit(False))
        else:
            cut = self._cut_off()
        return cut.join(_named(self.names, "source", "source_urn"), "source").select("source_urn")

    def _cut_off(self) -> DataFrame:
        """Sources with something left, found by nodes first.

        A node that no source reaches within the bound is left for whatever has a path of one hop more to it, and such paths
        are followed back from there by nodes alone.  Only sources without one are traced for themselves.
        """
        layer = cut_lineage(self._start.select("node").distinct())
        layers = [layer]
        for _ in range(self._max_hops):
            layer = cut_lineage(layer.join(self._links, "node").select(F.col("dst").alias("node")).distinct())
            layers.append(layer)
        seen = layers[0]
        for layer in layers[1:]:
            seen = seen.unionByName(layer)
        beyond = self._links.join(seen.distinct().withColumnRenamed("node", "dst"), "dst", "left_anti")
        back = cut_lineage(beyond.select("node").distinct())
        for _ in range(self._max_hops):
            back = cut_lineage(self._links.join(back.withColumnRenamed("node", "dst"), "dst", "left_semi").select("node").distinct())
        sure = cut_lineage(self._start.join(back, "node", "left_semi").select("source"))
        rest = self._start.join(sure, "source", "left_anti").select("source", "node")
        return sure.unionByName(self._trace(rest).truncated)


def downstream_reach(sources: DataFrame, edges: DataFrame, max_hops: int | None = None) -> AssetReach:
    """Assets below each source with their smallest hop: (source_urn, urn, hop_count).

    All sources are traced together; (source, urn) is the key of what was visited, so results never mix.
    """
    return AssetReach(sources, edges, max_hops)


def column_reach(sources: DataFrame, edges: DataFrame, max_hops: int | None = None) -> Reach:
    """Columns below a start column: (source_urn, start_column, urn, column, hop_count).

    An edge without a source column carries every column of its dataset, and an
    asset reached through one has an unknown (null) column from which every edge
    is followed: what is not known to be unaffected counts as reached.  Known
    columns meet their own edges and the column-less ones; unknown columns meet
    the wildcard copy of each edge.  All three are one equi join, over only those
    edges that leave a dataset of the frontier, each under the keys asked for there.

    A cycle may lead back to another column of the start dataset.  Those rows are
    kept here (they are traced on) and left out by ``reached_assets``.  Datasets are
    hashes of their names while tracing, or numbers should two names share a hash, and
    starts are numbered; the rows by name are written once.  ``edges`` are read twice.
    """
    spark = edges.sparkSession
    # An unknown column is an empty text while tracing, so that the distinct and
    # the anti join share one partitioning.
    edges = edges.filter(F.col("src_urn").isNotNull()).select(
        "src_urn",
        F.coalesce(F.lower("src_column"), F.lit(NO_COLUMN)).alias("edge_key"),
        "dst_urn",
        F.when(F.col("src_column").isNotNull(), F.coalesce(F.lower("dst_column"), F.lit(NO_COLUMN)))
        .otherwise(NO_COLUMN)
        .alias("dst_column"),
    )
    starts = sources.select("source_urn", F.coalesce(F.lower("start_column"), F.lit(NO_COLUMN)).alias("start_column")).distinct()
    starts = cut_lineage(starts.withColumn("start", F.monotonically_increasing_id()))
    ends = edges.select(F.explode(F.array("src_urn", "dst_urn")).alias("urn")).unionByName(starts.select(F.col("source_urn").alias("urn")))
    names = cut_lineage(ends.filter(F.col("urn").isNotNull()).distinct().select(_hashed("urn").alias("id"), "urn"))
    if names.groupBy("id").count().filter("count > 1").isEmpty():
        plain = edges.select(_hashed("src_urn").alias("node"), "edge_key", _hashed("dst_urn").alias("dst"), "dst_column")
        first = starts.filter(F.col("source_urn").isNotNull()).withColumn("node", _hashed("source_urn"))
    else:
        names = _numbered(names.select("urn"))
        numbered = edges.join(_named(names, "node", "src_urn"), "src_urn").join(_named(names, "dst", "dst_urn"), "dst_urn", "left")
        plain = numbered.select("node", "edge_key", "dst", "dst_column")
        first = starts.join(_named(names, "node", "source_urn"), "source_urn")
    first = first.select("start", "node", F.col("start_column").alias("column"))
    begun = cut_lineage(first.select("node").distinct().withColumn("begun", F.lit(True)))

    def parted(rows: DataFrame) -> list[DataFrame]:
        """Rows by whether their dataset is the start of a trace, written once, so that the size of each part is known."""
        flagged = rows.join(begun, "node", "left").withColumn("begun", F.coalesce("begun", F.lit(False)))
        path = fresh_path(spark, "parted")
        flagged.write.partitionBy("begun").parquet(path, compression=STAGE_CODEC)
        written = spark.read.schema(flagged.schema).parquet(path)
        return [written.filter(F.col("begun") == flag).drop("begun") for flag in (True, False)]

    leaving = parted(plain)
    known = F.col("column") != NO_COLUMN
    keys = F.when(known, F.array(F.col("column"), F.lit(NO_COLUMN))).otherwise(F.array(F.lit(ANY_COLUMN)))
    named = F.col("some_known") & ((F.col("edge_key") == NO_COLUMN) | (F.col("marks").bitwiseAND(_mark("edge_key")) != 0))
    asked = F.array_compact(F.array(F.when(F.col("some_unknown"), F.lit(ANY_COLUMN)), F.when(named, F.col("edge_key"))))

    def expand(frontier: DataFrame) -> DataFrame:
        # The datasets are few beside the edges.  Starts are seldom met again: then their edges need not move.
        nodes = frontier.groupBy("node").agg(
            F.bool_or(known).alias("some_known"), F.bool_or(~known).alias("some_unknown"), F.bit_or(_mark("column")).alias("marks")
        )
        pairs = [*zip(leaving, parted(nodes), strict=True)]
        pairs = [(mine, some) for mine, some in pairs if not some.isEmpty()] or pairs[:1]
        met = [mine.join(some, "node").select("node", F.explode(asked).alias("key"), "dst", "dst_column") for mine, some in pairs]
        keyed = met[0] if len(met) == 1 else met[0].unionByName(met[1])
        return (
            frontier.withColumn("key", F.explode(keys))
            .join(keyed, ["node", "key"])
            .select("start", F.col("dst").alias("node"), F.col("dst_column").alias("column"))
        )

    reach = _trace(first, expand, ["start"], max_hops)
    rows = reach.rows.join(starts, "start").join(_named(names, "node", "urn"), "node", "left")
    rows = rows.select("source_urn", "start_column", "urn", F.when(known, F.col("column")).alias("column"), "hop_count")
    return Reach(cut_lineage(rows), reach.truncated.join(starts, "start").select("source_urn", "start_column"))


def reached_assets(columns: DataFrame) -> DataFrame:
    """One row per source and asset: smallest hop, and whether a column is known."""
    return (
        columns.groupBy("source_urn", "start_column", "urn")
        .agg(F.min("hop_count").alias("hop_count"), (F.count("column") > 0).alias("has_columns"))
        .filter(F.col("urn") != F.col("source_urn"))
    )


# Tag words that mark an asset, matched anywhere in the tag text.
CRITICAL_WORDS = ("critical", "finance")
SENSITIVE_WORDS = ("pii", "sensitive")
OWNER_PREFIXES = ("urn:li:corpuser:", "urn:li:corpGroup:")
TAG_PREFIX = "urn:li:tag:"


def tag_signals(tags: DataFrame) -> DataFrame:
    """Critical and sensitive flags per asset from tag names (urn, tag, tag_name).

    A tag of the wrong shape, or listed twice, makes the asset's tags malformed.
    """
    text = F.lower(F.concat_ws(" ", "tag", "tag_name"))

    def any_word(words: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        return hit

    per_tag = tags.groupBy("urn", "tag").agg(
        F.bool_or(any_word(CRITICAL_WORDS)).alias("critical"),
        F.bool_or(any_word(SENSITIVE_WORDS)).alias("sensitive"),
        (F.count(F.lit(1)) > 1).alias("repeated"),
    )
    bad = F.col("repeated") | ~F.coalesce(F.col("tag").startswith(TAG_PREFIX), F.lit(False))
    return per_tag.groupBy("urn").agg(
        F.bool_or("critical").alias("critical_asset"),
        F.bool_or("sensitive").alias("sensitive_data"),
        F.bool_or(bad).alias("tags_malformed"),
    )


def owners_state(owners: DataFrame) -> DataFrame:
    """Distinct owners per asset, and whether an owner is malformed or repeated."""
    right = F.lit(False)
    for prefix in OWNER_PREFIXES:
        right = right | F.coalesce(F.col("owner").startswith(prefix), F.lit(False))
    per_owner = owners.groupBy("urn", "owner").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    return per_owner.groupBy("urn").agg(
        F.count(F.lit(1)).alias("owner_count"),
        F.bool_or(F.col("repeated") | ~right).alias("owners_malformed"),
    )


def asset_facts(assets: DataFrame, owners: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per catalog asset with the facts the score needs.

    ``assets``: urn, name, ownership_known.  ``has_owners`` is null when
    ownership was not established, false when it is established as empty.
    """
    joined = assets.join(owners_state(owners), "urn", "left").join(tag_signals(tags), "urn", "left")
    false = F.lit(False)
    return joined.select(
        "urn",
        "name",
        F.when(F.col("ownership_known"), F.coalesce("owner_count", F.lit(0)) > 0).alias("has_owners"),
        F.coalesce("critical_asset", false).alias("critical_asset"),
        F.coalesce("sensitive_data", false).alias("sensitive_data"),
        (F.coalesce("owners_malformed", false) | F.coalesce("tags_malformed", false)).alias("malformed"),
    )


def enrich_assets(reached: DataFrame, facts: DataFrame) -> DataFrame:
    """Attach catalog facts to reached assets; assets unknown to the catalog stay.

    ``reached`` has run_key, change_id, urn, hop_count and has_columns.
    """
    found = facts.withColumn("found", F.lit(True))
    false = F.lit(False)
    return even_join(reached, found, ["urn"], "left").select(
        *CHANGE_KEY,
        "urn",
        asset_type(F.col("urn")).alias("asset_type"),
        "name",
        "hop_count",
        "has_owners",
        F.coalesce("critical_asset", false).alias("critical_asset"),
        F.coalesce("sensitive_data", false).alias("sensitive_data"),
        F.col("has_columns").alias("direct_column_lineage"),
        F.coalesce("found", false).alias("found"),
        F.coalesce("malformed", false).alias("malformed"),
    )


def ownership_status(changes: DataFrame, enriched: DataFrame) -> DataFrame:
    """Per change: complete if every reached asset was found, or none was reached."""
    seen = enriched.groupBy(*CHANGE_KEY).agg(
        F.bool_and("found").alias("all_found"), F.bool_or("malformed").alias("any_malformed")
    )
    status = (
        F.when(F.coalesce("any_malformed", F.lit(False)), "unavailable")
        .when(F.coalesce("all_found", F.lit(True)), "complete")
        .otherwise("missing")
    )
    return changes.select(*CHANGE_KEY).join(seen, CHANGE_KEY, "left").select(
        *CHANGE_KEY, status.alias("ownership")
    )


def drop_unavailable(enriched: DataFrame, status: DataFrame) -> DataFrame:
    """An enrichment that failed lists no asset at all."""
    # Written, as it is small or empty as a rule: its size is known before the assets would be shuffled to meet it.
    failed = cut_lineage(status.filter(F.col("ownership") == "unavailable").select(*CHANGE_KEY))
    kept = even_join(enriched, failed, CHANGE_KEY, "left_anti")
    return kept.drop("found", "malformed")


def _assertion_keys(assertions: DataFrame) -> DataFrame:
    """Join keys of an assertion: its fields and the wildcard, or no column at all."""
    fields = F.col("fields") if "fields" in assertions.columns else F.array("field")
    rows = assertions.select("assertion_urn", "dataset_urn", F.explode_outer(assertion_fields(fields)).alias("key"))
    by_field = rows.filter(F.col("key").isNotNull()).distinct()
    whole = rows.groupBy("assertion_urn", "dataset_urn").agg(
        F.when(F.count("key") == 0, NO_COLUMN).otherwise(ANY_COLUMN).alias("key")
    )
    return by_field.unionByName(whole)


def link_assertions(datasets: DataFrame, columns: DataFrame, assertions: DataFrame) -> DataFrame:
    """Assertions that may be touched by a change: (run, change, dataset, assertion).

    ``datasets``: run_key, change_id, dataset_urn, has_columns; ``columns``: the
    known affected columns in long form; ``assertions``: assertion_urn,
    dataset_urn, and field (null when none is stated) or a list ``fields``.  An assertion without fields
    is kept; with fields it is kept if one is affected or if the affected
    columns are unknown, and then ``unknown_columns`` is set.
    """
    base = datasets.select(
        *CHANGE_KEY,
        "dataset_urn",
        F.explode(
            F.when(F.col("has_columns"), F.array(F.lit(NO_COLUMN))).otherwise(
                F.array(F.lit(NO_COLUMN), F.lit(ANY_COLUMN))
            )
        ).alias("key"),
    )
    known = columns.select(*CHANGE_KEY, "dataset_urn", F.lower("column").alias("key"))
    keyed = _assertion_keys(assertions)
    hits = base.unionByName(known).join(keyed, ["dataset_urn", "key"])
    return hits.groupBy(*CHANGE_KEY, "dataset_urn", "assertion_urn").agg(
        F.bool_or(F.col("key") == ANY_COLUMN).alias("unknown_columns")
    )


def assertion_status(changes: DataFrame, links: DataFrame) -> DataFrame:
    unknown = links.groupBy(*CHANGE_KEY).agg(F.bool_or("unknown_columns").alias("unknown"))
    return changes.select(*CHANGE_KEY).join(unknown, CHANGE_KEY, "left").select(
        *CHANGE_KEY,
        F.when(F.coalesce("unknown", F.lit(False)), "ambiguous").otherwise("complete").alias("assertions"),
    )


def attach_assertions(enriched: DataFrame, links: DataFrame) -> DataFrame:
    """``has_assertions`` per impacted asset: established, so never null here."""
    linked = links.select(*CHANGE_KEY, F.col("dataset_urn").alias("urn")).distinct()
    return enriched.join(linked.withColumn("linked", F.lit(True)), [*CHANGE_KEY, "urn"], "left").withColumn(
        "has_assertions", F.coalesce("linked", F.lit(False))
    ).drop("linked")


def assertion_assets(sources: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """Assertions on the changed dataset itself become impacted assets.

    Their owners and signals are not established, which is null, not false.
    ``sources``: run_key, change_id, source_urn; ``names``: assertion_urn, name.
    """
    own = links.join(
        sources.select(*CHANGE_KEY, F.col("source_urn").alias("dataset_urn")),
        [*CHANGE_KEY, "dataset_urn"],
        "left_semi",
    )
    named = names.groupBy("assertion_urn").agg(F.min("name").alias("name"))
    unknown = F.lit(None).cast("boolean")
    return own.join(named, "assertion_urn", "left").select(
        *CHANGE_KEY,
        F.col("assertion_urn").alias("urn"),
        F.lit("assertion").alias("asset_type"),
        "name",
        F.lit(1).alias("hop_count"),
        unknown.alias("has_owners"),
        unknown.alias("critical_asset"),
        unknown.alias("sensitive_data"),
        unknown.alias("direct_column_lineage"),
        F.lit(True).alias("has_assertions"),
    )


def audit_pages(
    pages: DataFrame,
    items: DataFrame,
    max_hops: int | None = None,
    window: int | None = None,
    max_pages: int | None = None,
    item_prefix: str | None = None,
) -> DataFrame:
    """Is a result that arrived in pages provably complete?

    ``pages``: request_id, page_no (0-based), page_offset, returned, total,
    has_more, and optionally truncated_children, the number of children that the
    source says it left out; ``items``: request_id, page_no, item_urn, degree.
    Neighbouring pages are compared by pairing each page's end with the next
    page's start on the key (request, boundary): no page list is gathered, and a
    request with very many pages is spread like any other rows.  ``has_more`` may
    be null where a source does not state it.  Items whose page has no row make a
    request incomplete, also where no page of it has one.  A result is never
    doubted for its size: ``window`` and ``max_pages`` are limits of a source that
    has them, and by default there is none.
    """
    far = F.col("degree") >= 1 if max_hops is None else F.col("degree").between(1, max_hops)
    counted = items.groupBy("request_id", "page_no").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.bool_or(
            ~F.coalesce(valid_urn(F.col("item_urn")), F.lit(False))
            | (F.lit(False) if item_prefix is None else ~F.coalesce(F.col("item_urn").startswith(item_prefix), F.lit(False)))
            | ~F.coalesce(far, F.lit(False))
        ).alias("bad_item"),
    )
    repeated = (
        items.groupBy("request_id", "item_urn")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("request_id")
        .agg(F.bool_or(F.col("n") > 1).alias("repeated_item"))
    )
    cut_off = F.coalesce(F.col("truncated_children"), F.lit(0)) != 0 if "truncated_children" in pages.columns else F.lit(False)
    listed = pages.withColumn("listed", F.lit(True)).withColumn("cut_off", cut_off)
    full = listed.join(counted, ["request_id", "page_no"], "full_outer").withColumn(
        "n_items", F.coalesce("n_items", F.lit(0))
    )
    end = F.col("page_offset") + F.col("returned")
    steps = full.filter("listed").select(
        "request_id",
        F.inline(
            F.array(
                F.struct(
                    F.col("page_no").alias("boundary"),
                    F.col("page_offset").alias("opens"),
                    F.lit(None).cast("bigint").alias("closes"),
                ),
                F.struct(
                    (F.col("page_no") + 1).alias("boundary"),
                    F.lit(None).cast("bigint").alias("opens"),
                    end.cast("bigint").alias("closes"),
                ),
            )
        ),
    )
    boundaries = steps.groupBy("request_id", "boundary").agg(
        F.count("opens").alias("n_open"),
        F.count("closes").alias("n_close"),
        F.max("opens").alias("opens"),
        F.max("closes").alias("closes"),
    )
    broken = (F.col("n_open") > 1) | F.when(
        F.col("boundary") == 0, (F.col("n_open") != 1) | (F.col("opens") != 0)
    ).otherwise((F.col("n_open") == 1) & ((F.col("n_close") != 1) | (F.col("opens") != F.col("closes"))))
    chain = boundaries.groupBy("request_id").agg(F.bool_or(broken).alias("broken_chain"))

    total = F.col("total")
    ends_here = end >= total
    bad_page = (
        (F.col("returned") != F.col("n_items"))
        | (F.col("returned") < 0)
        | (total < 0)
        | (end > total)
        | (F.col("has_more").isNotNull() & (F.col("has_more") != (end < total)))
        | ((F.col("returned") == 0) & (end < total))
    )
    per_request = full.groupBy("request_id").agg(
        F.count("listed").alias("n_pages"),
        F.bool_or(F.col("listed").isNull()).alias("page_missing"),
        F.bool_or(F.coalesce("cut_off", F.lit(False))).alias("cut_off"),
        F.min("total").alias("low_total"),
        F.max("total").alias("high_total"),
        F.sum("n_items").alias("n_items"),
        F.bool_or(F.when(F.col("listed"), F.coalesce(bad_page, F.lit(True))).otherwise(False)).alias("bad_page"),
        F.bool_or(F.coalesce("bad_item", F.lit(False))).alias("bad_item"),
        F.count_if(ends_here).alias("n_last"),
    )
    joined = per_request.join(chain, "request_id", "left").join(repeated, "request_id", "left")
    too_wide = F.lit(False) if window is None else F.col("high_total") > window
    too_many = F.lit(False) if max_pages is None else F.col("n_pages") > max_pages
    reason = (
        F.when(~F.col("low_total").eqNullSafe(F.col("high_total")), "total_changed")
        .when(F.col("page_missing"), "page_missing")
        .when(F.coalesce("broken_chain", F.lit(True)), "offset_gap")
        .when(F.col("bad_page"), "page_invalid")
        .when(F.col("cut_off"), "children_truncated")
        .when(F.col("bad_item"), "item_invalid")
        .when(F.coalesce("repeated_item", F.lit(False)), "item_repeated")
        .when(too_wide, "window_exceeded")
        .when(too_many, "too_many_pages")
        .when((F.col("n_last") != 1) | (F.col("n_items") != F.col("high_total")), "incomplete")
    )
    return joined.select(
        "request_id",
        "n_pages",
        F.col("n_items").cast("bigint").alias("n_items"),
        F.col("high_total").cast("bigint").alias("total"),
        F.when(reason.isNull(), "complete").otherwise("truncated").alias("status"),
        reason.alias("reason"),
    )
