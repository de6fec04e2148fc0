"""Diagnosis codes: prefix groups, version mapping, look-back flags and code lists."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import DAY_US, micros, time_block
from ..functions.parse import ATC_PREFIX_LENGTHS, atc_levels, clean_code
from ..session import materialize
from .comorbidity_groups import FLAGS

#: A dimension below this many rows is copied to every executor, a larger one is shuffled.
BROADCAST_ROWS = 200_000
#: Look-back of the comorbidity and code-list features, in days (five times 356).
LOOKBACK_DAYS = 356 * 5


def small_or_shuffled(dimension: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only when the counted size allows it."""
    return F.broadcast(dimension) if rows <= BROADCAST_ROWS else dimension


def prefix_hits(df: DataFrame, dimension: DataFrame, code: str = "icd_code", version: str = "icd_version") -> DataFrame:
    """Every row of ``df`` once per matching prefix, with ``scheme`` and ``group``.

    A code is cut to the prefix lengths in use and joined by equality, so the join stays
    a hash join. With a dimension of checked size it needs no shuffle at all.
    """
    facts = dimension.agg(
        F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set(F.length("prefix"))).alias("lengths")
    ).first()
    clean = clean_code(code)
    cuts = F.array_distinct(F.array(*[F.substring(clean, 1, n) for n in facts["lengths"]]))
    pieces = df.select("*", F.explode(cuts).alias("prefix"))
    lookup = small_or_shuffled(dimension.withColumnRenamed("version", version), facts["rows"])
    return pieces.join(lookup, [version, "prefix"]).select(*df.columns, "scheme", "group")


def match_prefixes(codes: DataFrame, dimension: DataFrame, code: str = "icd_code", version: str = "icd_version") -> DataFrame:
    """Distinct (code, version, scheme, group) for every code that starts with a group's prefix."""
    return prefix_hits(codes.select(code, version).distinct(), dimension, code, version).distinct()


def code_groups(
    codes: DataFrame,
    dimension: DataFrame,
    mapping: str,
    descriptions: DataFrame | None = None,
    code: str = "icd_code",
    version: str = "icd_version",
) -> DataFrame:
    """Every distinct code with its description and the sorted list of its groups."""
    if mapping not in ("elixhauser", "charlson", "custom"):
        raise ValueError("mapping must be one of 'elixhauser', 'charlson', 'custom'")
    hits = match_prefixes(codes, dimension.filter(F.col("scheme") == mapping), code, version)
    grouped = hits.groupBy(code, version).agg(F.sort_array(F.collect_set("group")).alias("_groups"))
    base = codes.select(code, version).distinct()
    if descriptions is not None:
        base = base.join(descriptions, [code, version], "left")
    else:
        base = base.withColumn("description", F.lit(None).cast("string"))
    return base.join(grouped, [code, version], "left").select(
        code,
        version,
        "description",
        F.coalesce("_groups", F.array().cast("array<string>")).alias(f"{mapping}_comorbidity"),
    )


def rejected_codes(codes: DataFrame, known: DataFrame, code: str = "icd_code", version: str = "icd_version") -> DataFrame:
    """Codes that fail the input checks, with the reason: bad version, missing or unknown code."""
    bad_version = ~F.coalesce(F.col(version).isin(9, 10), F.lit(False))
    distinct = codes.select(code, version).distinct()
    unknown = distinct.filter(~bad_version & F.col(code).isNotNull()).join(known, [code, version], "left_anti")
    broken = distinct.filter(bad_version | F.col(code).isNull())
    return broken.withColumn(
        "reason", F.when(bad_version, "version").otherwise("missing")
    ).unionByName(unknown.withColumn("reason", F.lit("unknown")))


def unique_code_map(pairs: DataFrame, rank: str | None = None) -> DataFrame:
    """One target per source code: the one with the greatest ``rank``, else the greatest target.

    Maps may repeat source codes; without a rank column the rule is by value, so
    that the result does not depend on file order.
    """
    order = F.struct(rank, "target_code") if rank else F.col("target_code")
    return pairs.groupBy("source_code").agg(F.max_by("target_code", order).alias("target_code"))


def convert_codes(
    df: DataFrame,
    code_map: DataFrame,
    to_version: int,
    digit3: bool = False,
    code: str = "icd_code",
    version: str | None = "icd_version",
    out: str = "converted",
) -> DataFrame:
    """Maps codes of the other version; unknown codes and codes already in the target version stay.

    ``digit3`` cuts to three characters, and only codes that were mapped from version 10
    (or any code, when there is no version column).
    """
    from_version = {9: 10, 10: 9}[to_version]
    foreign = F.col(version) == from_version if version else F.lit(True)
    lookup = code_map.select(F.col("source_code").alias(code), F.col("target_code").alias("_target"))
    lookup = small_or_shuffled(lookup, code_map.count())
    joined = df.join(lookup, code, "left")
    mapped = F.coalesce("_target", code)
    if digit3 and to_version == 9:
        mapped = F.substring(mapped, 1, 3)
    return joined.withColumn(out, F.when(foreign, mapped).otherwise(F.col(code))).drop("_target")


def dated_diagnoses(diagnoses: DataFrame, admissions: DataFrame) -> DataFrame:
    """Diagnoses with the discharge time of their admission."""
    times = admissions.select("subject_id", "hadm_id", "dischtime")
    return diagnoses.join(times, ["subject_id", "hadm_id"], "left")


def _slices(df: DataFrame, time_us: Column, width_us: int) -> DataFrame:
    """Every event twice: in its own time slice (``_cur``) and, as history, in the next one (``_prev``).

    A slice is as long as the look-back. Inside one slice every earlier event is recent
    enough; of the slice before, all events are earlier. So "is there an event within
    the look-back" needs only the first time of this slice and the last of the previous.
    """
    slice_no = time_block(time_us, width_us)
    both = F.array(
        F.struct(slice_no.alias("slice"), time_us.alias("cur"), F.lit(None).cast("long").alias("prev")),
        F.struct((slice_no + 1).alias("slice"), F.lit(None).cast("long").alias("cur"), time_us.alias("prev")),
    )
    return df.select("*", F.explode(both).alias("_s")).select(
        *df.columns, F.col("_s.slice").alias("_slice"), F.col("_s.cur").alias("_cur"), F.col("_s.prev").alias("_prev")
    )


#: Flags that fit into one whole number, one bit each.
FLAGS_PER_MASK = 62


def recent_facts(
    visits: DataFrame,
    events: DataFrame,
    facts: Sequence[str],
    event_time: str,
    days: int,
    subject: str = "subject_id",
    start: str = "intime",
    key: str = "stay_id",
    how: str = "inner",
    along: bool = False,
) -> DataFrame:
    """Rows (subject, key, ``_hits``): per visit the distinct ``facts`` of events with ``0 < start - time <= days``.

    Events are dealt by (subject, time slice) once; there they shrink to the first and last
    time per facts, and all of a (subject, slice) are packed into one row. A visit meets that one
    row and filters its marks, so visits are neither multiplied nor grouped again. With ``how="left"``
    a visit without events in its slices is kept, with no list. ``along`` is for visits and events
    that both lie by subject already; they stay where they are.
    """
    width = days * DAY_US
    timed = events.filter(F.col(event_time).isNotNull()).select(F.col(subject), *facts, micros(event_time).alias("_time"))
    # Few events of a slice repeat a fact, so a shuffle by fact before the one by slice would move them all twice.
    dealt = _slices(timed, F.col("_time"), width).drop("_time")
    dealt = dealt if along else dealt.repartition(subject, "_slice")
    marks = dealt.groupBy(subject, "_slice", *facts).agg(F.min("_cur").alias("_first"), F.max("_prev").alias("_last"))
    packed = marks.groupBy(subject, "_slice").agg(F.collect_list(F.struct("_first", "_last", *facts)).alias("_marks"))
    at = micros(start)
    asked = visits.select(F.col(key), F.col(subject), at.alias("_at"), time_block(at, width).alias("_slice"))
    recent = lambda m: (m["_first"] < F.col("_at")) | (m["_last"] >= F.col("_at") - F.lit(width))
    met = asked.join(packed, [subject, "_slice"], how)
    hits = F.transform(F.filter("_marks", recent), lambda m: F.struct(*[m[f].alias(f) for f in facts]))
    return met.select(subject, key, hits.alias("_hits"))


def _masks(flag_numbers: Sequence[Column], flags: int) -> list[Column]:
    """One whole number per ``FLAGS_PER_MASK`` flags with the bit of every flag number given."""
    chunks = range((flags + FLAGS_PER_MASK - 1) // FLAGS_PER_MASK)
    bit = lambda n, k: F.when(
        F.floor(n / FLAGS_PER_MASK) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (n - k * FLAGS_PER_MASK).cast("int"))
    ).otherwise(F.lit(0).cast("long"))
    return [F.bit_or(bit(n, k)).alias(f"_mask_{k}") for k in chunks for n in flag_numbers]


def _folded_masks(hits: DataFrame, flags: int, subject: str, key: str) -> DataFrame:
    """Rows (subject, key, ``_mask_0`` ...): the bits of all ``_hits`` together."""
    chunks = range((flags + FLAGS_PER_MASK - 1) // FLAGS_PER_MASK)
    zero = F.lit(0).cast("long")
    folded = lambda k: F.aggregate("_hits", zero, lambda x, h: x.bitwiseOR(F.coalesce(h[f"_mask_{k}"], zero)))
    return hits.select(subject, key, *[folded(k).alias(f"_mask_{k}") for k in chunks])


def flags_of_masks(flags: Sequence[str]) -> list[Column]:
    """0/1 columns from the bit masks of a row."""
    mask = lambda i: F.coalesce(F.col(f"_mask_{i // FLAGS_PER_MASK}"), F.lit(0).cast("long"))
    return [F.getbit(mask(i), F.lit(i % FLAGS_PER_MASK)).cast("int").alias(f) for i, f in enumerate(flags)]


def _flag_columns(visits: DataFrame, hits: DataFrame, flags: Sequence[str], subject: str, key: str) -> DataFrame:
    """0/1 columns from the bit masks in ``_hits``, joined to the visits once."""
    joined = visits.join(_folded_masks(hits, len(flags), subject, key), [subject, key], "left")
    return joined.select(*visits.columns, *flags_of_masks(flags))


def lookback_flags(
    visits: DataFrame,
    events: DataFrame,
    flags: Sequence[str],
    event_time: str,
    days: int,
    flag_column: str = "flag",
    subject: str = "subject_id",
    start: str = "intime",
    key: str = "stay_id",
) -> DataFrame:
    """0/1 column per flag: an event with that flag has ``0 < start - time <= days``.

    Only visit keys and times take part in the look-back (:func:`recent_facts`); its hits
    are bit masks that are joined to the visits at the end.
    """
    numbers = F.create_map(*[F.lit(x) for i, f in enumerate(flags) for x in (f, i)])
    known = events.select("*", numbers[F.col(flag_column)].alias("_flag")).filter(F.col("_flag").isNotNull())
    keyed = known.groupBy(subject, event_time).agg(*_masks([F.col("_flag")], len(flags)))
    facts = [c for c in keyed.columns if c.startswith("_mask_")]
    return _flag_columns(visits, recent_facts(visits, keyed, facts, event_time, days, subject, start, key), flags, subject, key)


def flag_names(schemes: Sequence[str]) -> list[str]:
    return [flag for s in schemes for flag in FLAGS[s].values()]


def code_facts(
    codes: DataFrame,
    dimension: DataFrame,
    schemes: Sequence[str] = ("charlson", "elixhauser"),
) -> DataFrame:
    """Every distinct (icd_code, icd_version) with the flags of its comorbidity groups, ``_mask_0 ...``.

    The distinct codes are written once, so the diagnoses are read once for all of it.
    """
    known = materialize(codes.select("icd_code", "icd_version").distinct())
    numbers = {flag: i for i, flag in enumerate(flag_names(schemes))}
    pairs = [(f"{s}|{g}", numbers[flag]) for s in schemes for g, flag in FLAGS[s].items()]
    number = F.create_map(*[F.lit(x) for pair in pairs for x in pair])[F.concat_ws("|", "scheme", "group")]
    hits = prefix_hits(known, dimension.filter(F.col("scheme").isin(*schemes)))
    masks = hits.groupBy("icd_code", "icd_version").agg(*_masks([number], len(numbers)))
    return known.join(masks, ["icd_code", "icd_version"], "left")


def dated_facts(dated: DataFrame, facts: DataFrame) -> tuple[DataFrame, list[str]]:
    """``dated`` or bare diagnoses with the columns of :func:`code_facts`, and the names of these.

    Facts of counted size are sent to the diagnoses, which a shuffle by code would put on a few tasks.
    """
    names = [c for c in facts.columns if c not in ("icd_code", "icd_version")]
    same = F.col("icd_code").eqNullSafe(F.col("_code")) & F.col("icd_version").eqNullSafe(F.col("_version"))
    renamed = facts.withColumnsRenamed({"icd_code": "_code", "icd_version": "_version"})
    renamed = small_or_shuffled(renamed, facts.count())
    return dated.join(renamed, same, "left").drop("_code", "_version"), names


def comorbidity_flags(
    visits: DataFrame,
    diagnoses: DataFrame,
    admissions: DataFrame,
    dimension: DataFrame,
    days: int = LOOKBACK_DAYS,
    schemes: Sequence[str] = ("charlson", "elixhauser"),
) -> DataFrame:
    """Adds the 0/1 comorbidity columns of every scheme from earlier discharges of the subject.

    Groups are matched once per distinct code; codes with the same groups are one mark.
    """
    masks = comorbidity_masks(visits, diagnoses, admissions, dimension, days, schemes)
    joined = visits.join(masks, ["subject_id", "stay_id"], "left")
    return joined.select(*visits.columns, *flags_of_masks(flag_names(schemes)))


def comorbidity_masks(
    visits: DataFrame,
    diagnoses: DataFrame,
    admissions: DataFrame,
    dimension: DataFrame,
    days: int = LOOKBACK_DAYS,
    schemes: Sequence[str] = ("charlson", "elixhauser"),
    deal: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The flags of :func:`comorbidity_flags` as bit masks: rows (subject_id, stay_id, ``_mask_0`` ...).

    The bits of an admission are put together first, on the map side, so the look-back moves
    one row per admission. With ``deal``, which deals by subject, all of it and the result lie by subject.
    """
    known, facts = dated_facts(diagnoses, code_facts(diagnoses, dimension, schemes))
    known = known.filter(F.col(facts[0]).isNotNull())
    marked = known.groupBy("subject_id", "hadm_id").agg(*[F.bit_or(f).alias(f) for f in facts])
    along = deal is not None
    if along:
        visits, marked, admissions = deal(visits), deal(marked), deal(admissions)
    hits = recent_facts(visits, dated_diagnoses(marked, admissions), facts, "dischtime", days, along=along)
    return _folded_masks(hits, len(flag_names(schemes)), "subject_id", "stay_id")


def lookback_codes(
    visits: DataFrame,
    events: DataFrame,
    code: str,
    event_time: str,
    days: int,
    subject: str = "subject_id",
    start: str = "intime",
    key: str = "stay_id",
) -> DataFrame:
    """Rows (subject, key, code), each once: the codes a visit's subject had within the look-back."""
    hits = recent_facts(visits, events, [code], event_time, days, subject, start, key)
    return hits.select(subject, key, F.explode(F.col("_hits")[code]).alias(code))


def code_index(codes: DataFrame, code: str) -> DataFrame:
    """Distinct codes with a gap-free number (0, 1, ...) in code order: columns ``code``, ``code_idx``.

    Codes are cut into text ranges (at cuts from a sample of the codes themselves, so a
    common beginning does not matter), numbered inside their range and shifted by the
    counts of the ranges before it: no task sees the whole vocabulary.
    """
    distinct = codes.select(F.col(code).alias("code")).filter(F.col("code").isNotNull()).distinct()
    partitions = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, so that ranges and their counts come from the same cuts.
    placed = materialize(distinct.repartitionByRange(partitions, "code").withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range").orderBy("code")
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(shift), "_range")
        .select("code", (F.col("_shift") + F.col("_rn") - 1).cast("long").alias("code_idx"))
    )


#: code list variant -> (target version, cut to three characters).
LIST_VARIANTS = {"v9": (9, False), "v9_3digit": (9, True), "v10": (10, False)}


def numbered_codes(events: DataFrame, maps: Mapping[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """Every distinct (icd_code, icd_version) once, written: a gap-free ``_id`` and its code in each variant of ``names``.

    ``maps`` holds the unique code maps these need (``9to10``, ``10to9``).
    """
    pairs = events.select(F.struct("icd_code", "icd_version").alias("pair"))
    known = code_index(pairs, "pair").select("code.*", F.col("code_idx").cast("int").alias("_id"))
    for name in names:
        version, digit3 = LIST_VARIANTS[name]
        known = convert_codes(known, maps["9to10" if version == 10 else "10to9"], version, digit3, out=name)
    return materialize(known)


def lookback_lists(
    visits: DataFrame,
    dated: DataFrame,
    maps: Mapping[str, DataFrame],
    names: Sequence[str],
    days: int = LOOKBACK_DAYS,
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Per variant of ``names`` the lists of :func:`code_lists` and the index of their codes.

    All variants come from one look-back, which handles the numbers of the given codes; each
    variant is looked up in its result. The dated events are written once, as both need them.
    """
    timed = dated.filter(F.col("dischtime").isNotNull())
    events = materialize(timed.select("subject_id", "icd_code", "icd_version", "dischtime"))
    facts = numbered_codes(events, maps, names)
    numbered, ids = dated_facts(events, facts.select("icd_code", "icd_version", "_id"))
    hits = recent_facts(visits, numbered, ids, "dischtime", days, how="left")
    found = F.when(F.col("stay_id").isNotNull(), F.col("_hits")["_id"])
    lists = materialize(hits.select("stay_id", found.alias("_ids")))
    used = materialize(facts.join(lists.select(F.explode("_ids").alias("_id")).distinct(), "_id", "left_semi"))
    known = facts.count()
    return {name: numbered_lists(lists, used, known, name) for name in names}


def _constant(values: Sequence, kind: str) -> Column:
    """A list as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def numbered_lists(lists: DataFrame, used: DataFrame, known: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Per stay ``icd_list`` and ``icd_encoded_list`` of one variant; and the index of its codes.

    ``lists`` holds a stay's ``_ids``, ``used`` the codes of all these among ``known`` codes. Codes of
    small counted size are sent to the lists as a whole; more of them are joined, and grouped by stay.
    """
    index = code_index(used, name)
    places = used.join(index, F.col(name) == F.col("code")).select("_id", "code", "code_idx")
    if known <= BROADCAST_ROWS:
        number_of, code_of = [None] * known, {}
        for row in places.collect():
            number_of[row["_id"]], code_of[row["code_idx"]] = row["code_idx"], row["code"]
        number = lambda i: F.get(_constant(number_of, "bigint"), i)
        code = lambda n: F.get(_constant([code_of[n] for n in sorted(code_of)], "string"), n)
        # Numbers follow code order, so both lists stand in the same order.
        numbers = F.sort_array(F.array_distinct(F.array_compact(F.transform("_ids", number))))
        both = lists.select("stay_id", numbers.alias("_numbers")).withColumn("_codes", F.transform("_numbers", code))
    else:
        met = lists.select("stay_id", F.explode("_ids").alias("_id")).join(places, "_id")
        pairs = F.array_sort(F.collect_set(F.struct("code_idx", "code"))).alias("_pairs")
        both = lists.select("stay_id").join(met.groupBy("stay_id").agg(pairs), "stay_id", "left").select(
            "stay_id", F.col("_pairs")["code_idx"].alias("_numbers"), F.col("_pairs")["code"].alias("_codes")
        )
    empty = lambda t: F.array().cast(f"array<{t}>")
    out = both.select(
        "stay_id",
        F.coalesce("_codes", empty("string")).alias("icd_list"),
        F.coalesce("_numbers", empty("bigint")).alias("icd_encoded_list"),
    )
    return out, index


def code_lists(
    visits: DataFrame,
    dated: DataFrame,
    code_map: DataFrame,
    variant: str,
    days: int = LOOKBACK_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """Per stay the sorted distinct codes of earlier discharges and their numbers; and the index.

    ``dated`` comes from :func:`dated_diagnoses`; a list holds distinct codes only, so its
    length is bounded by the code vocabulary.
    """
    if variant not in LIST_VARIANTS:
        raise ValueError(f"variant must be one of {sorted(LIST_VARIANTS)}")
    maps = {"9to10": code_map, "10to9": code_map}
    return lookback_lists(visits, dated, maps, [variant], days)[variant]


def atc_classes(drugs: DataFrame, atc: DataFrame, column: str = "atc_id") -> DataFrame:
    """Rows (drug code, level 1-5, code, description) from one lookup table of all levels."""
    prefixes = atc_levels(column)
    levels = F.array(
        *[F.struct(F.lit(n).alias("level"), prefixes[n].alias("code")) for n in sorted(ATC_PREFIX_LENGTHS)]
    )
    long = drugs.select(column).distinct().select(column, F.explode(levels).alias("l")).select(column, "l.*")
    return long.join(small_or_shuffled(atc, atc.count()), ["level", "code"], "left").select(
        column, "level", "code", "description"
    )


def merge_code_lists(visits: DataFrame, lists: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Code-list features joined to the visits by stay."""
    renamed = lists.withColumnsRenamed(dict(columns or {}))
    return visits.join(renamed, "stay_id", "left")
