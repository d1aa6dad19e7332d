"""Covariates from dictionary-term mentions.

A mention row carries participant, module, term, the concept codes of its module
and two assertion flags. All steps are column expressions and one or two
pre-aggregated shuffles; nothing loops over participants.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covaria.functions import keys as K
from covaria.functions import text as X
from covaria.operators import cohort as C
from covaria.operators import scale

KEYS = ("empi", "expdate")
MENTIONS_PER_TASK = 100_000
# The column that names the concept in each module.
CONCEPT_COLUMNS = {
    "ade": "SNOMED_PrefTerm",
    "Allergy": "rxcui",
    "Medication": "concept_id",
    "Problem": "UMLS_CUI",
}
# Summary columns of each module, in the order concept as given,
# concept derived, concept rows, term as given, term derived, clean term, term rows.
SUMMARY_COLUMNS = {
    "ade": (
        "most_frequent_ade_concept_orig",
        "most_frequent_ade_derived",
        "concept_ade_module_entries",
        "most_frequent_ade_term_orig",
        "most_frequent_ade_term_derived_unclean",
        "most_frequent_ade_derived_clean",
        "term_ade_module_entries",
    ),
    "Allergy": (
        "most_frequent_allergy_concept_orig",
        "most_frequent_allergy_concept_derived",
        "concept_allergy_module_entries",
        "most_frequent_allergy_term_orig",
        "most_frequent_allergy_term_derived_unclean",
        "most_frequent_allergy_term_derived_clean",
        "term_allergy_module_entries",
    ),
    "Medication": (
        "most_frequent_medication_concept_orig",
        "most_frequent_medication_concept_derived",
        "concept_medication_module_entries",
        "most_frequent_medication_term_orig",
        "most_frequent_medication_term_derived_unclean",
        "most_frequent_medication_term_derived_clean",
        "term_medication_module_entries",
    ),
    "Problem": (
        "most_frequent_problem_concept_orig",
        "most_frequent_problem_concept_derived",
        "concept_problem_module_entries",
        "most_frequent_problem_term_orig",
        "most_frequent_problem_term_derived_unclean",
        "most_frequent_problem_term_derived_clean",
        "term_problem_module_entries",
    ),
}


def cohort_of_path(path: str) -> tuple[str, str]:
    """Dataset and cohort of a cohort file: a folder ``max_...`` holds Medicaid, others Medicare."""
    folders = path.split("/")
    tagged = [i for i, f in enumerate(folders[:-1]) if f.startswith(("max_", "mcr_"))]
    name = folders[tagged[0] + 1].strip() if tagged else ""
    return ("Medicaid" if "max_" in path else "Medicare"), name


def group_pattern(
    dataset: str, cohort: str, groups: Mapping[str, Mapping[str, str]], default: str
) -> str:
    """The name pattern of a cohort's files: by dataset and cohort, else the default group."""
    return groups.get(dataset, {}).get(cohort, default)


def select_groups(
    mentions: DataFrame,
    path: Column,
    cohort_paths: Sequence[str],
    groups: Mapping[str, Mapping[str, str]],
    default: str,
) -> DataFrame:
    """Mentions of each cohort file's dataset and group, with ``dataset`` and ``cohort``.

    The choices are made before the rows are read: one scan, a test of the path per
    cohort file, and a row for each file that takes it. No join.
    """
    chosen = []
    for name in cohort_paths:
        dataset, cohort = cohort_of_path(name)
        pattern = group_pattern(dataset, cohort, groups, default)
        tag = F.struct(F.lit(dataset).alias("dataset"), F.lit(cohort).alias("cohort"))
        chosen.append(F.when(path.contains(dataset) & path.contains(pattern), tag))
    return mentions.select("*", F.inline(F.array_compact(F.array(*chosen))))


def of_cohort(cohort: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions of cohort members at their own index date."""
    named = mentions.withColumn("empi", F.col("key").cast("string"))
    return C.restrict_to_cohort(named, cohort, KEYS)


def key_census(mentions: DataFrame) -> DataFrame:
    """Rows per participant and index date."""
    return mentions.groupBy("key", "expdate").agg(F.count(F.lit(1)).alias("n"))


def no_terms(cohort: DataFrame, mentions: DataFrame) -> DataFrame:
    """Cohort members without any mention at their index date."""
    named = mentions.select(F.col("key").cast("string").alias("empi"), "expdate")
    return C.without_rows(cohort, named, KEYS)


def concept_tag(module: Column) -> Column:
    """The module's concept code with a prefix; ``NA`` for an unmapped module."""
    tag = F.lit("NA")
    for name, column in CONCEPT_COLUMNS.items():
        code = F.coalesce(F.col(column).cast("string"), F.lit("NA"))
        tag = F.when(module == name, F.concat(F.lit("concept_"), code)).otherwise(tag)
    return F.when(tag == "concept_", F.lit("concept_NA")).otherwise(tag)


def tagger(mentions: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``tagged`` for rows of these mentions, wherever the rows have moved to.

    A dictionary has far fewer names than there are mentions, so names are cleaned
    once each, staged, and broadcast back. Names too many for that are cleaned per row.
    """
    module = F.coalesce(F.col("module"), F.lit("NA"))
    term = F.coalesce(F.col("term"), F.lit("NA"))
    raw_names = {
        "concept_tags": concept_tag(module),
        "term_names": X.decimal_mark(F.concat(F.lit("term_"), module, F.lit("_"), term)),
    }
    both = F.array("term_names", "concept_tags")
    raw = mentions.withColumns(raw_names).select(F.explode(both).alias("raw")).distinct()
    names = scale.staged(raw.withColumn("clean", X.clean_name(F.col("raw"))), "names")
    wanted = {"clean_terms": "term_names", "clean_concept_tags": "concept_tags"}
    few = scale.small(names)

    def tag(rows: DataFrame) -> DataFrame:
        named = rows.withColumns(raw_names)
        if not few:
            return named.withColumns({out: X.clean_name(F.col(raw)) for out, raw in wanted.items()})
        for out, raw in wanted.items():
            listed = names.select(F.col("raw").alias(raw), F.col("clean").alias(out))
            named = named.join(F.broadcast(listed), raw, "left")
        return named

    return tag


def tagged(mentions: DataFrame) -> DataFrame:
    """Mentions with raw and clean term and concept names."""
    return tagger(mentions)(mentions)


def _indicator(clean: Column, raw: Column, assertion: str) -> Column:
    """1 for the row's own feature, 0 when negated or about the family, null if unknown."""
    denied = (F.col("family_history_mod") > 0) | (F.col("negated_mod") > 0)
    if assertion == "literal":
        denied = (raw == clean) & denied
    value = F.when(denied, 0).when(denied.isNull(), F.lit(None)).otherwise(1)
    return F.when(clean.endswith("_na"), 1).otherwise(value)


def indicators(mentions: DataFrame, assertion: str = "intended") -> DataFrame:
    """Two long rows per mention: its clean term and its clean concept.

    ``literal`` adjusts for negation only where raw and clean name are the same text.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(family).alias("family"),
                F.col(clean).alias("feature"),
                _indicator(F.col(clean), F.col(raw), assertion).alias("indicator"),
            )
            for family, clean, raw in (
                ("term", "clean_terms", "term_names"),
                ("concept", "clean_concept_tags", "concept_tags"),
            )
        ]
    )
    return mentions.select(*KEYS, F.inline(pairs))


def term_frequency(
    cohort: DataFrame, mentions: DataFrame, assertion: str = "intended"
) -> DataFrame:
    """Sum of indicators per participant and feature.

    A participant without mentions has one missing term and one missing concept. Columns that
    name no term, concept or assertion are neither shuffled nor written.
    """
    wanted = ("module", "term", *CONCEPT_COLUMNS.values(), "negated_mod", "family_history_mod")
    inside = scale.staged(of_cohort(cohort, mentions).select(*KEYS, *wanted), "cohort-mentions")
    rows = indicators(tagged(inside), assertion)
    sums = rows.groupBy(*KEYS, "family", "feature").agg(
        F.sum(F.coalesce("indicator", F.lit(0))).alias("frequency")
    )
    missing = F.array(
        F.struct(F.lit("term").alias("family"), F.lit("term_na").alias("feature")),
        F.struct(F.lit("concept").alias("family"), F.lit("concept_na").alias("feature")),
    )
    empty = C.without_rows(cohort, inside.select(*KEYS), KEYS).select(*KEYS, F.inline(missing))
    return sums.unionByName(empty.withColumn("frequency", F.lit(1).cast("bigint")))


def term_binary(frequency: DataFrame) -> DataFrame:
    value = K.positive_to_one(F.col("frequency"), F.col("frequency"))
    return frequency.select(*KEYS, "family", "feature", value.alias("value"))


def mode_columns(mentions: DataFrame) -> list[str]:
    """All columns of the mentions but the keys, whatever the files have."""
    return [c for c in mentions.columns if c not in (*KEYS, "key")]


def _filled(mentions: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Null text as ``NA``, so that a missing value can win a mode."""
    text = {f.name for f in mentions.schema.fields if f.dataType.simpleString() == "string"}
    return [F.coalesce(c, F.lit("NA")).alias(c) if c in text else F.col(c) for c in columns]


def _winners(counted: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The most frequent value per group, the smallest of several, and all rows of the group."""
    ranked = F.struct((-F.col("n")).alias("n"), *values)
    best = counted.groupBy(*groups).agg(F.min(ranked).alias("best"), F.sum("n").alias("rows"))
    return best.select(*groups, *[F.col(f"best.{v}").alias(v) for v in values], "rows")


def _modes(
    rows: DataFrame,
    shown: Callable[[DataFrame], DataFrame],
    kept: Sequence[str],
    cells: Column,
    values: Sequence[str],
    out: Sequence[Column],
) -> DataFrame:
    """One row per participant of ``out`` over the winners of each kind of cell.

    Rows move once, as they are, to the task of their participant, and are ``shown`` and taken apart
    there; the number of tasks grows with the rows. Participants that fill more than one task are
    counted by cell all over the cluster; there are fewer of them than tasks.
    """
    spark = rows.sparkSession
    rows = rows.select(*_filled(rows, KEYS), *[c for c in rows.columns if c not in KEYS])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // MENTIONS_PER_TASK)
    shares = max(scale.fair_share(spark), tasks)
    hot = F.broadcast(scale.staged(scale.hot_keys(rows, KEYS, shares).select(*KEYS), "hot-participants"))

    def won(part: DataFrame) -> DataFrame:
        groups = [*KEYS, *kept, "kind"]
        each = shown(part).select(*KEYS, *kept, F.inline(cells))
        counted = each.groupBy(*groups, *values).agg(F.count(F.lit(1)).alias("n"))
        return _winners(counted, groups, values).groupBy(*KEYS).agg(*out)

    whole = rows.join(hot, list(KEYS), "left_anti").repartition(tasks, *KEYS)
    return won(whole).unionByName(won(rows.join(hot, list(KEYS), "left_semi")))


def participant_modes(
    mentions: DataFrame, columns: Sequence[str], tag: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Most frequent value of each column per participant; ties go to the smallest.

    ``mentions`` are read three times. Whole numbers and dates are compared as numbers. With ``tag``
    (a ``tagger``) mentions come without their names, which are added where the rows have moved to.
    """

    def shown(part: DataFrame) -> DataFrame:
        full = tag(part) if tag else part
        return full.select(*KEYS, *_filled(full, columns))

    kinds = {f.name: f.dataType for f in shown(mentions).schema.fields}
    cells = []
    for i, c in enumerate(columns):
        whole = isinstance(kinds[c], (T.IntegralType, T.DateType))
        day = isinstance(kinds[c], T.DateType)
        number = F.unix_date(c) if day else F.col(c)
        cells.append(
            F.struct(
                F.lit(i).alias("kind"),
                (F.lit(None) if whole else F.col(c)).cast("string").alias("text"),
                (number if whole else F.lit(None)).cast("bigint").alias("number"),
            )
        )
    out = []
    for i, c in enumerate(columns):
        own = F.col("kind") == i
        if isinstance(kinds[c], T.DateType):
            value = F.date_from_unix_date(F.max(F.when(own, F.col("number"))).cast("int"))
        elif isinstance(kinds[c], T.IntegralType):
            value = F.max(F.when(own, F.col("number"))).cast(kinds[c])
        else:
            value = F.max(F.when(own, F.col("text"))).cast(kinds[c])
        out.append(value.alias(c))
    return _modes(mentions, shown, [], F.array(*cells), ["text", "number"], out)


def module_summary(
    mentions: DataFrame, tag: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Modes and row counts of concepts and terms in each of the four modules.

    A module without rows gives nulls. ``mentions`` are read three times; ``tag`` as in ``participant_modes``.
    """
    code = F.lit(None).cast("string")
    for name, column in CONCEPT_COLUMNS.items():
        given = F.coalesce(F.col(column).cast("string"), F.lit("NA"))
        code = F.when(F.col("module") == name, given).otherwise(code)
    kinds = ("code", "clean_concept_tags", "term", "term_names", "clean_terms")

    def shown(part: DataFrame) -> DataFrame:
        full = (tag(part) if tag else part).withColumn("code", code)
        return full.select(*KEYS, *_filled(full, ["module", *kinds]))

    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in kinds])
    out = []
    for module, names in SUMMARY_COLUMNS.items():

        def own(kind: str, column: str, module: str = module) -> Column:
            here = (F.col("module") == module) & (F.col("kind") == kind)
            return F.max(F.when(here, F.col(column)))

        wanted = ("code", "clean_concept_tags", None, "term", "term_names", "clean_terms", None)
        for kind, name in zip(wanted, names):
            cell = own("code", "rows") if kind is None else own(kind, "v")
            out.append(cell.alias(name))
    inside = mentions.where(F.col("module").isin(*CONCEPT_COLUMNS))
    return _modes(inside, shown, ["module"], pairs, ["v"], out)


def missing_summary(cohort: DataFrame, mentions: DataFrame) -> DataFrame:
    """Rows without concept, without term, and all rows, per cohort member."""
    counts = mentions.groupBy(*KEYS).agg(
        F.count_if(F.col("clean_concept_tags") == "concept_na").alias("missing_concept"),
        F.count_if(F.col("clean_terms") == "term_na").alias("missing_term"),
        F.count(F.lit(1)).alias("total_entries"),
    )
    joined = cohort.select(*KEYS).join(counts, list(KEYS), "left")
    return joined.select(
        *KEYS,
        "missing_concept",
        F.coalesce("missing_term", F.lit(1)).cast("bigint").alias("missing_term"),
        F.coalesce("total_entries", F.lit(0)).cast("bigint").alias("total_entries"),
    )


def as_features(frequency: DataFrame) -> DataFrame:
    return frequency.select(
        *KEYS, "family", "feature", F.col("frequency").cast("double").alias("value")
    )
