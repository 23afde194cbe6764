"""Who is the same person: phone standardising, blank names, merging duplicates.

Every grouping here is an aggregate with a map-side part, never a window over a
group, so one phone or one lead holding a third of all rows shrinks to a single
row per input task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.runtime import stage
from leadbook.functions.identity import name_key, normalize_phone, phone_status

NAME_KEY = "name_key"
PHONE_STATUS = "phone_status"
RICHNESS = "richness"
_RANK = "__rank"

# Row order and richness share one sortable number: richness in the high bits.
_ORDER_BITS = 48
_MAX_RICHNESS = (1 << 15) - 1

_BOOKKEEPING = {
    S.ROW_ORD, S.UPLOAD_ID, S.SOURCE_FILE, S.SOURCE_SHEET, S.PHONE_NORM, S.MERGED_COUNT,
    S.MERGED_SOURCES, S.MEMBER_FRAMES, NAME_KEY, PHONE_STATUS, RICHNESS, "phone_bucket",
}
_MAPS = (S.EXTRAS, S.NOTE_FIELDS)
# Columns of a stored row that are not merged value by value.
_DERIVED = _BOOKKEEPING - {S.UPLOAD_ID, S.SOURCE_FILE, S.SOURCE_SHEET}


def with_phone_identity(df: DataFrame, phone_col: str = "phone") -> DataFrame:
    """Add the standard phone, its status and the name key (kept where a stored table has them)."""
    if {S.PHONE_NORM, PHONE_STATUS, NAME_KEY} <= set(df.columns):
        return df
    name = F.col("name") if "name" in df.columns else F.lit(None).cast("string")
    known = df.withColumns({S.PHONE_NORM: normalize_phone(F.col(phone_col)), NAME_KEY: name_key(name)})
    return known.withColumn(PHONE_STATUS, phone_status(F.col(phone_col), F.col(S.PHONE_NORM)))


def filled_identity(df: DataFrame, phone_col: str = "phone") -> DataFrame:
    """Stored rows, some of which were stored without keys: those get them here."""
    fresh = {S.PHONE_NORM: normalize_phone(F.col(phone_col)), NAME_KEY: name_key(F.col("name")), PHONE_STATUS: phone_status(F.col(phone_col))}
    known = F.col(PHONE_STATUS).isNotNull()
    return df.withColumns({c: F.when(known, F.col(c)).otherwise(value) for c, value in fresh.items()})


def reachable(df: DataFrame, phone_col: str = "phone") -> DataFrame:
    """Rows with a valid mobile, keyed; the others cannot be called or matched."""
    keyed = with_phone_identity(df, phone_col)
    return keyed.filter(F.col(S.PHONE_NORM).isNotNull())


def richness(df: DataFrame) -> Column:
    """How many lead fields of the row hold something."""
    terms = []
    for name in df.columns:
        if name in _MAPS:
            terms.append(f"greatest(size(map_filter(`{name}`, (k, v) -> v IS NOT NULL)), 0)")
        elif name not in _BOOKKEEPING and not name.startswith("__"):
            terms.append(f"int(`{name}` IS NOT NULL)")
    return F.expr(" + ".join(terms) or "0")


def sole_names(keyed: DataFrame) -> DataFrame:
    """Phones that carry exactly one real name, with that name's key."""
    named = keyed.filter(F.col(NAME_KEY) != "")
    per_phone = named.groupBy(S.PHONE_NORM).agg(
        F.min(NAME_KEY).alias("sole_key"), F.max(NAME_KEY).alias("__last_key")
    )
    return per_phone.filter(F.col("sole_key") == F.col("__last_key")).drop("__last_key")


def name_groups(keyed: DataFrame) -> DataFrame:
    """One row per (phone, name key) with its row count and resolved key.

    A nameless group joins the only named lead on its phone; with two or more
    names, or none, it stays a lead of its own.
    """
    groups = keyed.groupBy(S.PHONE_NORM, NAME_KEY).agg(F.count(F.lit(1)).alias("rows"))
    named = groups.filter(F.col(NAME_KEY) != "").withColumn("resolved_key", F.col(NAME_KEY))
    blank = groups.filter(F.col(NAME_KEY) == "").join(sole_names(keyed), S.PHONE_NORM, "left")
    resolved = blank.withColumn("resolved_key", F.coalesce("sole_key", F.lit(""))).drop("sole_key")
    return named.unionByName(resolved)


def _merge_order() -> Column:
    score, order = F.col(RICHNESS).cast("long"), F.col(S.ROW_ORD)
    in_range = order.between(0, (1 << _ORDER_BITS) - 1) & (score <= _MAX_RICHNESS)
    packed = (F.lit(_MAX_RICHNESS) - score) * F.lit(1 << _ORDER_BITS) + order
    return F.when(in_range, packed).otherwise(F.raise_error(F.lit("row_ord outside the merge order range")))


def row_states(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Every row as the merge state of a group of one: each value beside its row's rank.

    Values are structs (rank, value), maps hold such structs, and the sets of sources and
    uploads are arrays, so that states of any size merge by `merge_states` alone.
    """
    counted = keyed if RICHNESS in keyed.columns else keyed.withColumn(RICHNESS, richness(keyed))
    ranked = counted.withColumn(_RANK, _merge_order())
    plain = [c for c in keyed.columns if c not in keys and c not in _MAPS and c not in _DERIVED]
    best = [F.expr(f"CASE WHEN `{c}` IS NOT NULL THEN named_struct('rank', {_RANK}, 'value', `{c}`) END").alias(c) for c in plain]
    held = lambda v: F.struct(F.col(_RANK).alias("rank"), v.alias("value"))
    known = lambda c: F.map_filter(c, lambda _, v: v.isNotNull())
    maps = [F.transform_values(known(c), lambda _, v: held(v)).alias(c) for c in _MAPS if c in keyed.columns]
    sets = {S.SOURCE_FILE: S.MERGED_SOURCES, S.UPLOAD_ID: S.MEMBER_FRAMES}
    lineage = [F.array_compact(F.array(c)).alias(name) for c, name in sets.items() if c in keyed.columns]
    return ranked.select(*keys, _RANK, *best, *maps, F.lit(1).cast("long").alias(S.MERGED_COUNT), *lineage)


_SETS = (S.MERGED_SOURCES, S.MEMBER_FRAMES)


def _merge_maps(states: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The best-ranked value of every key of each map, as one map per group and column.

    The entries of all maps come from one pass, told apart by their column.
    """
    empty = F.array().cast("array<struct<key:string,value:struct<rank:bigint,value:string>>>")
    entry = lambda c: F.transform(
        F.coalesce(F.map_entries(c), empty), lambda e: F.struct(F.lit(c).alias("held"), e["key"].alias("field"), e["value"].alias("best"))
    )
    entries = states.select(*keys, F.explode(F.concat(*[entry(c) for c in columns])).alias("entry")).select(*keys, "entry.*")
    best = entries.groupBy(*keys, "held", "field").agg(F.min("best").alias("best"))
    held = lambda c: F.sort_array(F.collect_list(F.when(F.col("held") == c, F.struct("field", "best"))))
    maps = [F.when(F.size(held(c)) > 0, F.map_from_entries(held(c))).alias(c) for c in columns]
    return best.groupBy(*keys).agg(*maps)


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """One state per group: of every column the value of the best-ranked row that has one."""
    special = {*keys, _RANK, S.MERGED_COUNT, *_MAPS, *_SETS}
    aggregates = [F.min(_RANK).alias(_RANK), F.sum(S.MERGED_COUNT).alias(S.MERGED_COUNT)]
    aggregates += [F.min(f"`{c}`").alias(c) for c in states.columns if c not in special]
    aggregates += [F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in _SETS if c in states.columns]
    merged = states.groupBy(*keys).agg(*aggregates)
    maps = [c for c in _MAPS if c in states.columns]
    return merged.join(_merge_maps(states, keys, maps), keys, "left") if maps else merged


def merge_groups(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Coalesce the rows of each group, richest row first, then source order.

    Each column keeps the value of its best-ranked non-null row together with
    that rank, so merged groups can themselves be merged again exactly.
    """
    return merge_states(row_states(keyed, keys), keys)


def _attach(named: DataFrame, nameless: DataFrame) -> DataFrame:
    """Fold merged nameless groups into the named lead they resolve to, keep the rest."""
    keys = [S.PHONE_NORM, NAME_KEY]
    others = [c for c in nameless.columns if c not in keys]
    renamed = nameless.selectExpr(*keys, *[f"`{c}` AS `__nameless_{c}`" for c in others])
    joined = named.join(renamed, keys, "full")
    empty_list, empty_map = F.array().cast("array<string>"), F.create_map().cast("map<string,struct<rank:bigint,value:string>>")
    columns = {}
    for c in others:
        mine, theirs = F.col(c), F.col(f"__nameless_{c}")
        if c == S.MERGED_COUNT:
            columns[c] = F.coalesce(mine, F.lit(0)) + F.coalesce(theirs, F.lit(0))
        elif c == _RANK:
            columns[c] = F.least(mine, theirs)
        elif c in _SETS:
            columns[c] = F.array_union(F.coalesce(mine, empty_list), F.coalesce(theirs, empty_list))
        elif c in _MAPS:
            columns[c] = F.map_zip_with(F.coalesce(mine, empty_map), F.coalesce(theirs, empty_map), lambda _, a, b: F.least(a, b))
        else:
            columns[c] = F.expr(f"least(`{c}`, `__nameless_{c}`)")
    return joined.select(*keys, *[value.alias(c) for c, value in columns.items()])


def _finish(merged: DataFrame, shape: list[str]) -> DataFrame:
    """Unwrap ranked values and put the lead columns in the order of `shape`."""
    lead_columns = []
    for c in shape:
        if c in _DERIVED - {S.ROW_ORD}:
            continue
        if c == S.ROW_ORD:
            lead_columns.append(F.pmod(F.col(_RANK), F.lit(1 << _ORDER_BITS)).alias(c))
        elif c in _MAPS:
            lead_columns.append(F.transform_values(c, lambda _, v: v["value"]).alias(c))
        else:
            lead_columns.append(F.expr(f"`{c}`.value AS `{c}`"))
    lineage = [F.col(S.MERGED_COUNT)]
    if S.MERGED_SOURCES in merged.columns:
        lineage.append(F.array_join(F.array_sort(S.MERGED_SOURCES), " · ").alias(S.MERGED_SOURCES))
    if S.MEMBER_FRAMES in merged.columns:
        lineage.append(F.size(S.MEMBER_FRAMES).cast("long").alias(S.MEMBER_FRAMES))
    return merged.select(S.PHONE_NORM, NAME_KEY, *lead_columns, *lineage)


def leads_of(groups: DataFrame, shape: list[str] | None = None) -> DataFrame:
    """One row per lead from merged states, one per (phone, name key), which should be staged.

    The nameless groups, at most one per phone, attach to the only named lead of their
    phone.  Columns are those of `shape`, or all that the states hold.
    """
    special = (S.PHONE_NORM, NAME_KEY, _RANK, S.MERGED_COUNT, *_SETS)
    shape = shape or [S.ROW_ORD, *(c for c in groups.columns if c not in special)]
    named = groups.filter(F.col(NAME_KEY) != "")
    blank = groups.filter(F.col(NAME_KEY) == "")
    resolved = blank.join(sole_names(groups), S.PHONE_NORM, "left")
    resolved = resolved.withColumn(NAME_KEY, F.coalesce("sole_key", NAME_KEY)).drop("sole_key")
    return _finish(_attach(named, resolved), shape)


def merge_leads(df: DataFrame, phone_col: str = "phone", fields: tuple[str, ...] | None = None) -> DataFrame:
    """One row per (mobile, name): duplicates coalesced, unreachable rows dropped.

    Rows are shuffled once, already merged per task, on (phone, name key), and a
    second pass merges the entries of their maps.  The merged groups are stored;
    from there the nameless ones attach to their leads.  With `fields`, only these and the
    row order are merged and kept: rows still rank by all of their cells, but no other
    column is shuffled or stored.
    """
    keyed = reachable(df, phone_col)
    if fields is not None:
        ranked = keyed if RICHNESS in keyed.columns else keyed.withColumn(RICHNESS, richness(keyed))
        keyed = ranked.select(S.PHONE_NORM, NAME_KEY, RICHNESS, S.ROW_ORD, *[f for f in fields if f in df.columns and f != S.ROW_ORD])
    groups = stage(merge_groups(keyed, [S.PHONE_NORM, NAME_KEY]), "merged_groups")
    return leads_of(groups, keyed.columns)


def standardise(df: DataFrame, phone_col: str = "phone") -> DataFrame:
    """Rows as they are stored for merging: keyed, and with their richness counted."""
    keyed = with_phone_identity(df, phone_col)
    return keyed.withColumn(RICHNESS, richness(keyed))


def dedupe_stats(df: DataFrame, phone_col: str = "phone", by: tuple[str, ...] = ()) -> DataFrame:
    """What merging drops, joins and keeps: one row, or one per value of `by`.

    Needs only phone, name and file of each row.  Leads present in more than one
    file are counted per phone.
    """
    keyed = with_phone_identity(df, phone_col)
    source = F.col(S.SOURCE_FILE) if S.SOURCE_FILE in df.columns else F.lit(None).cast("string")
    groups = keyed.groupBy(*by, S.PHONE_NORM, PHONE_STATUS, NAME_KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.min(source).alias("first_file"), F.max(source).alias("last_file")
    )
    named = F.count_if(F.col(NAME_KEY) != "")
    nameless = F.count_if(F.col(NAME_KEY) == "")
    none = F.lit(0).cast("long")
    phones = (
        groups.filter(F.col(PHONE_STATUS) == "valid")
        .groupBy(*by, S.PHONE_NORM)
        .agg(
            F.sum("rows").alias("valid_rows"),
            (named + F.when(named == 1, 0).otherwise(F.least(nameless, F.lit(1)))).alias("leads"),
            (F.min("first_file") != F.max("last_file")).cast("long").alias("cross"),
        )
        .select(*by, "valid_rows", "leads", "cross", none.alias("invalid"), none.alias("missing"))
    )
    rows_with = lambda status: F.when(F.col(PHONE_STATUS) == status, F.col("rows")).otherwise(0)
    dropped = groups.filter(F.col(PHONE_STATUS) != "valid").select(
        *by, none.alias("valid_rows"), none.alias("leads"), none.alias("cross"),
        rows_with("invalid").alias("invalid"), rows_with("missing").alias("missing"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = phones.unionByName(dropped).groupBy(*by).agg(
        *[total(c) for c in ("valid_rows", "leads", "cross", "invalid", "missing")]
    )
    return sums.select(
        *by,
        (F.col("valid_rows") + F.col("invalid") + F.col("missing")).alias("input_rows"),
        F.col("invalid").alias("invalid_phone_dropped"),
        F.col("missing").alias("missing_phone_dropped"),
        (F.col("valid_rows") - F.col("leads")).alias("duplicate_rows_merged"),
        F.col("leads").alias("unique_leads"),
        F.col("cross").alias("cross_file_leads"),
    )
