"""Records whose fields drift between files: rescue-column ingestion and a change report.

Every record is read whole as a map of variants. Fields of the target schema are cast;
what is unknown or cannot be cast stays in a rescue column as JSON. The fields of a file
are those of its typed and rescued values; comparing each file with the file before it
names the fields that were added, removed, renamed or retyped. Renames approve further
names, whose rescued values are replayed into the typed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.runtime import materialize, row_count_up_to, small_side

#: Relative difference up to which two numbers are the same after a change of unit.
SAME = 1e-6
#: Texts that stand for no value.
NO_VALUE = ("", "n/a", "na", "nan", "none", "null", "-")

NUMBER_WITH_UNIT = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*[^\s0-9.,+-]{0,8}\s*$"

RECORD = ["file_id", "record_no"]
FIELDS = "map<string,variant>"
CELLS = "array<struct<key:string,kind:string,scalar:string,num:double>>"

#: The target schema: field -> type; whole numbers from zero are the only castable longs.
TARGETS = {"sample_interval": "double", "ac_frequency": "double", "total_records": "long"}


def _cells(fields: Column) -> Column:
    """(key, kind, scalar, num) of each field of a map. ``kind`` is number, text, object,
    list or boolean, null for a JSON null; ``scalar`` the text of the value itself, within
    an object or list too, null for no value; ``num`` its number, with or without unit.
    Each step is taken once for a value."""
    shaped = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("shape")))
    kind = lambda s: (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "list").when(s == "STRING", "text").when(s == "BOOLEAN", "boolean").when(s != "VOID", "number")
    )
    kinds = F.transform(shaped, lambda c: F.struct(c["key"].alias("key"), c["value"].alias("value"), kind(c["shape"]).alias("kind")))

    def inner(value: Column, what: Column) -> Column:
        within = F.coalesce(F.when(what == "object", F.try_variant_get(value, "$.value", "string")).otherwise(F.try_variant_get(value, "$[0]", "string")), F.to_json(value))
        return F.trim(F.when(what.isin("object", "list"), within).otherwise(F.try_variant_get(value, "$", "string")))

    texts = F.transform(kinds, lambda c: F.struct(c["key"].alias("key"), c["kind"].alias("kind"), inner(c["value"], c["kind"]).alias("t")))
    scalars = F.transform(texts, lambda c: F.struct(c["key"].alias("key"), c["kind"].alias("kind"), F.when(~F.lower(c["t"]).isin(*NO_VALUE), c["t"]).alias("scalar")))
    number = lambda c: F.when(c["kind"] == "number", c["scalar"].try_cast("double")).otherwise(
        F.nullif(F.regexp_extract(c["scalar"], NUMBER_WITH_UNIT, 1), F.lit("")).try_cast("double")
    )
    return F.transform(scalars, lambda c: F.struct(c["key"].alias("key"), c["kind"].alias("kind"), c["scalar"].alias("scalar"), number(c).alias("num")))


def _cast(num: Column, kind: str, tolerance: float = 0.0) -> Column:
    whole = F.abs(num - F.round(num)) <= tolerance
    return F.when((num >= 0) & whole & (num < 9e18), F.round(num)) if kind == "long" else num


def _without(fields: Column, key: Column) -> Column:
    return F.map_filter(fields, lambda k, _: k != key)


def _object(fields: Column) -> Column:
    """The JSON text of the fields, null if there are none."""
    return F.when(F.size(fields) > 0, F.to_json(fields))


def ingest(records: DataFrame, targets: dict[str, str] = TARGETS, payload: str = "payload", name_field: str = "dataset") -> DataFrame:
    """One row per record: file_id, record_no, logger_id, written_at, ``parsed``, dataset,
    the target fields, cast, ``forms`` (target -> kind of the value that was cast) and
    ``rescued``: the JSON object of all other fields and of target fields that cannot be
    cast, their values unchanged (null if there are none).

    Records given twice count once (the smallest payload). A payload that is no JSON
    object is not parsed and rescued as a text.
    """
    once = records.groupBy(*RECORD).agg(F.min("logger_id").alias("logger_id"), F.min("written_at").alias("written_at"), F.min(payload).alias("_payload"))
    sound = F.coalesce(F.schema_of_variant(F.try_parse_json("_payload")).startswith("OBJECT"), F.lit(False))
    rows = once.withColumn("parsed", sound).withColumn("_m", F.when(F.col("parsed"), F.from_json("_payload", FIELDS)))
    rows = rows.withColumn("_c", F.filter(_cells(F.map_filter("_m", lambda k, _: k.isin(*targets))), lambda c: c["num"].isNotNull()))
    mine = {t: F.get(F.filter("_c", lambda c: c["key"] == t), 0) for t in targets}
    rows = rows.withColumns({f"_n_{t}": _cast(c["num"], targets[t]) for t, c in mine.items()})
    cast = {t: F.col(f"_n_{t}").isNotNull() for t in targets}
    stays = F.map_filter("_m", lambda k, v: k != name_field)
    for t, c in cast.items():
        stays = F.when(c, _without(stays, F.lit(t))).otherwise(stays)
    forms = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(t).alias("k"), F.when(cast[t], c["kind"]).alias("v")) for t, c in mine.items()]), lambda e: e["v"].isNotNull()))
    rescued = F.when(F.col("parsed"), _object(stays)).otherwise(F.to_json(F.struct(F.col("_payload").alias("unparsed"))))
    name = F.try_variant_get(F.try_element_at("_m", F.lit(name_field)), "$", "string")
    return rows.select(*RECORD, "logger_id", "written_at", "parsed", name.alias("dataset"), *[F.col(f"_n_{t}").cast(k).alias(t) for t, k in targets.items()], forms.alias("forms"), rescued.alias("rescued"))


def field_cells(table: DataFrame, targets: dict[str, str] = TARGETS) -> DataFrame:
    """One row per file, record and key of an ingested table: (file_id, record_no, dataset,
    key, kind, scalar, num), from the typed columns and the rescued fields."""
    cell = lambda key, kind, scalar, num: F.struct(key.alias("key"), kind.alias("kind"), scalar.alias("scalar"), num.alias("num"))
    number = {t: F.col(t).cast("double") for t in targets}
    typed = F.filter(F.array(*[cell(F.lit(t), F.try_element_at("forms", F.lit(t)), n.cast("string"), n) for t, n in number.items()]), lambda c: c["kind"].isNotNull())
    fields = F.when(F.col("parsed"), F.from_json("rescued", FIELDS))
    return table.select(*RECORD, "dataset", F.explode(F.concat(typed, F.coalesce(_cells(fields), F.array().cast(CELLS)))).alias("c")).select(*RECORD, "dataset", "c.*")


def file_sequence(records: DataFrame) -> DataFrame:
    """(file_id, logger_id, written_at, next_id): files in the order they were written."""
    files = records.groupBy("file_id").agg(F.min("logger_id").alias("logger_id"), F.min("written_at").alias("written_at"))
    order = Window.partitionBy("logger_id").orderBy("written_at", "file_id")
    return files.withColumn("next_id", F.lead("file_id").over(order))


def _major_kind(kind: Column) -> Column:
    """The kind of most non-null values; equal counts go to the first in this list."""
    kinds = ("number", "text", "object", "list", "boolean")
    counts = [F.struct(F.count(F.when(kind == k, 1)).alias("n"), F.lit(-i).alias("first"), F.lit(k).alias("kind")) for i, k in enumerate(kinds)]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["kind"])


def _both_sides(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Each row as the new side of its own file's comparison and the old side of the next's."""
    side = F.explode(F.array(F.struct(F.col("file_id").alias("pair"), F.lit(True).alias("new")), F.struct(F.col("next_id").alias("pair"), F.lit(False).alias("new"))))
    return rows.join(files, "file_id").withColumn("_side", side).where(F.col("_side.pair").isNotNull()).select("*", "_side.pair", "_side.new").drop("_side")


def field_changes(cells: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, renames). ``changes``: (file_id, change_kind, field_before, field_after),
    the name that is missing being empty. ``renames``: (file_id, logger_id, before, after,
    power) where before = after * 1000 ** power.

    The first file of a logger has no changes. A field whose values are all null has no
    type. Names hold the same quantity if more of the comparable values of the records
    in both files agree than not; values of another form of nothing (null, "n/a") or of
    a number against a text are not comparable.
    """
    fields = cells.groupBy("file_id", "key").agg(_major_kind(F.col("kind")).alias("kind"))
    links = files.select("file_id", "next_id")
    first = files.select(F.col("next_id").alias("file_id")).where(F.col("file_id").isNotNull())
    sides = _both_sides(fields, links)
    new, old = F.col("new"), ~F.col("new")
    compared = sides.groupBy("pair", "key").agg(
        F.max(F.when(new, F.lit(1))).alias("in_new"), F.max(F.when(old, F.lit(1))).alias("in_old"),
        F.max(F.when(new, F.col("kind"))).alias("kind_new"), F.max(F.when(old, F.col("kind"))).alias("kind_old"),
    ).join(first.withColumnRenamed("file_id", "pair"), "pair", "left_semi")
    compared = materialize(compared, "compared")
    moved = compared.where(F.col("in_new").isNull() | F.col("in_old").isNull()).select("pair", "key", F.col("in_new").isNotNull().alias("new"))
    values = _both_sides(cells.where(F.col("scalar").isNotNull() & F.col("dataset").isNotNull()), links).join(moved, ["pair", "key", "new"], "left_semi")
    place = F.struct(F.when(new, F.col("record_no")).otherwise(-F.col("record_no")).alias("at"), "scalar", "num")
    values = values.groupBy("pair", "new", "dataset", "key").agg(F.min(place).alias("v"))
    was = values.where(old).select("pair", "dataset", F.col("key").alias("before"), F.col("v.scalar").alias("s0"), F.col("v.num").alias("n0"))
    now = values.where(new).select("pair", "dataset", F.col("key").alias("after"), F.col("v.scalar").alias("s1"), F.col("v.num").alias("n1"))
    met = was.join(now, ["pair", "dataset"])
    zero = (F.col("n0") == 0) & (F.col("n1") == 0)
    ratio = F.try_divide("n0", "n1")
    power = F.when(ratio > 0, F.round(F.log10(ratio) / 3)).cast("int")
    same_number = zero | (F.abs(ratio / F.pow(F.lit(1000.0), power) - 1) <= SAME)
    comparable = F.col("n0").isNotNull() == F.col("n1").isNotNull()
    agrees = F.when(F.col("n0").isNotNull(), F.coalesce(same_number, F.lit(False))).otherwise(F.lower("s0") == F.lower("s1"))
    judged = met.where(comparable).withColumn("agrees", agrees).withColumn("power", F.when(F.col("agrees") & ~F.coalesce(zero, F.lit(False)), F.coalesce(power, F.lit(0))))
    by_power = judged.groupBy("pair", "before", "after", "power").agg(F.count("*").alias("n"), F.count(F.when(F.col("agrees"), 1)).alias("ok"))
    best = F.max(F.struct(F.when(F.col("power").isNotNull(), F.col("ok")).otherwise(0).alias("ok"), (-F.abs(F.coalesce("power", F.lit(0)))).alias("near"), F.coalesce("power", F.lit(0)).alias("power")))
    spare = F.sum(F.when(F.col("power").isNull(), F.col("ok")).otherwise(0))
    scored = by_power.groupBy("pair", "before", "after").agg(F.sum("n").alias("n"), best.alias("b"), spare.alias("zeros"))
    scored = scored.select("pair", "before", "after", "n", (F.col("b.ok") + F.col("zeros")).alias("ok"), F.col("b.power").alias("power")).where(F.col("ok") * 2 > F.col("n"))
    rank = [F.desc("ok"), F.asc("n"), F.asc(F.abs("power"))]
    once = scored.withColumn("r0", F.row_number().over(Window.partitionBy("pair", "before").orderBy(*rank, "after"))).withColumn(
        "r1", F.row_number().over(Window.partitionBy("pair", "after").orderBy(*rank, "before"))
    )
    renames = materialize(once.where((F.col("r0") == 1) & (F.col("r1") == 1)).select("pair", "before", "after", "power"), "renames")
    gone = compared.where(F.col("in_new").isNull()).select("pair", "key", F.col("kind_old").alias("kind"))
    come = compared.where(F.col("in_old").isNull()).select("pair", "key", F.col("kind_new").alias("kind"))

    def row(frame: DataFrame, what: str, before: Column, after: Column) -> DataFrame:
        return frame.select(F.col("pair").alias("file_id"), F.lit(what).alias("change_kind"), before.alias("field_before"), after.alias("field_after"))

    kinds = renames.join(gone.withColumnsRenamed({"key": "before", "kind": "k0"}), ["pair", "before"]).join(
        come.withColumnsRenamed({"key": "after", "kind": "k1"}), ["pair", "after"]
    )
    kept = compared.where((F.col("in_new") == 1) & (F.col("in_old") == 1) & (F.col("kind_new") != F.col("kind_old")))
    removed = gone.join(renames.select("pair", F.col("before").alias("key")), ["pair", "key"], "left_anti")
    added = come.join(renames.select("pair", F.col("after").alias("key")), ["pair", "key"], "left_anti")
    empty = F.lit("")
    changes = (
        row(renames, "renamed", F.col("before"), F.col("after"))
        .unionByName(row(kinds.where(F.col("k0") != F.col("k1")), "retyped", F.col("before"), F.col("after")))
        .unionByName(row(kept, "retyped", F.col("key"), F.col("key")))
        .unionByName(row(removed, "removed", F.col("key"), empty))
        .unionByName(row(added, "added", empty, F.col("key")))
    )
    named = renames.withColumnRenamed("pair", "file_id")
    return changes, named.join(files.select("file_id", "logger_id"), "file_id")


def approved_names(renames: DataFrame, targets: dict[str, str] = TARGETS) -> DataFrame:
    """(logger_id, key, target, power): names that renames lead to from the target fields,
    with target = value * 1000 ** power; one target per name, by the most renames. Chains
    of renames are followed to their end. A logger's own renames decide for it; rows with
    a null logger hold what the renames of all loggers together lead to."""
    alone = _followed(renames.where(F.col("logger_id").isNotNull()), ["logger_id"], targets)
    together = _followed(renames, [], targets).select(F.lit(None).cast(dict(renames.dtypes)["logger_id"]).alias("logger_id"), "key", "target", "power")
    return alone.select("logger_id", "key", "target", "power").unionByName(together)


def _followed(renames: DataFrame, by: list[str], targets: dict[str, str]) -> DataFrame:
    votes = renames.groupBy(*by, "before", "after", "power").agg(F.count("*").alias("votes"))
    edges = votes.select(*by, F.col("before").alias("a"), F.col("after").alias("b"), F.col("power").alias("step"), "votes").unionByName(
        votes.select(*by, F.col("after").alias("a"), F.col("before").alias("b"), (-F.col("power")).alias("step"), "votes")
    )
    edges = materialize(edges, "edges")
    start = renames.sparkSession.createDataFrame([(t, t, 0) for t in targets], "key string, target string, power int")
    known = edges.select(*by).distinct().crossJoin(F.broadcast(start)) if by else start  # one row per target field
    while True:
        reach = known.withColumnRenamed("key", "a").join(edges, [*by, "a"]).join(known.select(*by, F.col("key").alias("b")), [*by, "b"], "left_anti")
        if not row_count_up_to(reach, 0):
            return known
        step = reach.groupBy(*by, "b", "target", (F.col("power") + F.col("step")).cast("int").alias("power")).agg(F.sum("votes").alias("votes"))
        pick = F.row_number().over(Window.partitionBy(*by, "b").orderBy(F.desc("votes"), F.abs("power"), "target"))
        fresh = step.withColumn("_r", pick).where(F.col("_r") == 1).select(*by, F.col("b").alias("key"), "target", "power")
        known = materialize(known.unionByName(fresh), "names")


def replay(table: DataFrame, names: DataFrame, targets: dict[str, str] = TARGETS) -> DataFrame:
    """Moves rescued values of approved names into the typed columns that are still null:
    of several castable ones the first by name. Only the value that was stored leaves the
    rescue column; all others stay there unchanged."""
    fields = F.when(F.col("parsed"), F.from_json("rescued", FIELDS))
    cells = table.select(*RECORD, "logger_id", F.explode(_cells(fields)).alias("c")).select(*RECORD, "logger_id", "c.key", "c.num")
    mine = small_side(names.where(F.col("logger_id").isNotNull()).select(F.col("logger_id").alias("_l"), F.col("key").alias("_k"), F.struct("target", "power").alias("own")))
    anyone = small_side(names.where(F.col("logger_id").isNull()).select("key", F.struct("target", "power").alias("other")))
    met = cells.join(mine, (cells["logger_id"] == mine["_l"]) & (cells["key"] == mine["_k"]), "left").join(anyone, "key", "left")
    met = met.withColumn("as", F.coalesce("own", "other")).where(F.col("as").isNotNull())
    num = F.col("num") * F.pow(F.lit(1000.0), F.col("as.power"))
    met = met.select(*RECORD, "key", F.col("as.target").alias("target"), num.alias("num"))
    typed = {t: F.when(F.col("target") == t, _cast(F.col("num"), kind, 1e-6)) for t, kind in targets.items()}
    best = [F.min(F.when(v.isNotNull(), F.struct("key", v.alias("v")))).alias(f"_{t}") for t, v in typed.items()]
    joined = table.join(met.groupBy(*RECORD).agg(*best), RECORD, "left").withColumn("_left", F.when(F.col("parsed"), F.from_json("rescued", FIELDS)))
    moved = F.lit(False)
    for t, kind in targets.items():
        use = F.col(t).isNull() & F.col(f"_{t}.key").isNotNull()
        moved = moved | use
        joined = joined.withColumn("_left", F.when(use, _without(F.col("_left"), F.col(f"_{t}.key"))).otherwise(F.col("_left")))
    joined = joined.withColumn("rescued", F.when(moved, _object(F.col("_left"))).otherwise(F.col("rescued")))
    filled = {t: F.coalesce(F.col(t), F.col(f"_{t}.v").cast(kind)) for t, kind in targets.items()}
    return joined.withColumns(filled).drop("_left", *[f"_{t}" for t in targets])
