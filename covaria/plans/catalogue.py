"""The registered queries: each runs operators over whole tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covaria.config import OUTPUT_ELEMENTS, JobConfig
from covaria.functions import keys as K
from covaria.functions import parse as P
from covaria.functions import text as X
from covaria.operators import clusters as CL
from covaria.operators import codes as CO
from covaria.operators import coherence as CH
from covaria.operators import cohort as C
from covaria.operators import embeddings as E
from covaria.operators import indexing as RI
from covaria.operators import matrix as M
from covaria.operators import ngrams as N
from covaria.operators import scale
from covaria.operators import sentences as SE
from covaria.operators import terms as T
from covaria.operators import topic_table as TT
from covaria.operators import topics as TP
from covaria.plans import jobs as PL
from covaria.sources import fixtures as FX
from covaria.sources import readers as R
from covaria.sources import writers as W
from covaria.sources.schemas import MTERMS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOP_K = 20_000
TOPICS = 10
WORDS_PER_TOPIC = 40
TABLE_TOPICS = 5
TABLE_STEPS = 4
COHERENCE_TOPICS = 5
# Groups of term files by dataset and cohort; cohorts not listed take the default group.
GROUPS = {
    "Medicaid": {"cohort1": "grp0_", "cohort2": "grp1_"},
    "Medicare": {"cohort1": "grp1_", "cohort2": "grp2_"},
}
DEFAULT_GROUP = "grp3_"
COHORTS = ("cohort1", "cohort2", "cohort3")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scale.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- cohort, keys and windows -------------------------------------------------


@query
def cohort_notes_join(spark, sf):
    events = FX.notes(spark, sf).select("note_id", "empi", "notedate", "notetype", "text")
    joined = C.cohort_join(FX.cohort(spark, sf).select("empi", "expdate"), events, "notedate")
    return joined.select(
        "note_id", "empi", "expdate", "notedate", "notetype", F.length("text").alias("chars")
    )


def _window(spark, sf, mode="signed"):
    return C.note_window(FX.notes(spark, sf), mode=mode)


@query
def note_window_signed(spark, sf):
    return _window(spark, sf).select("note_id", "empi", "expdate", "notedate", "days")


@query
def note_window_abs(spark, sf):
    return _window(spark, sf, "abs").select("note_id", "empi", "expdate", "notedate", "days")


@query
def note_flatten(spark, sf):
    return C.flattened_notes(FX.notes(spark, sf)).select(
        "empi", "expdate", "notedate", "diffdays", "notetype", "Outcome", "note_number", "text"
    )


def _flags(spark, sf):
    flagged = FX.cohort(spark, sf)
    return flagged.withColumns({name: F.lit(1) for name in C.HELPER_COLUMNS})


@query
def washout_365(spark, sf):
    return K.key_first(C.washout(_flags(spark, sf), 365), "empi", "expdate")


@query
def washout_180(spark, sf):
    return K.key_first(C.washout(_flags(spark, sf), 180), "empi", "expdate")


@query
def washout_repeated(spark, sf):
    kept = C.washout(_flags(spark, sf), repeated_measure=True)
    return K.key_first(kept, "empi", "expdate")


@query
def washout_none(spark, sf):
    return K.key_first(C.washout(FX.cohort(spark, sf), 0), "empi", "expdate")


@query
def first_index_date(spark, sf):
    orders = FX.table(spark, sf, "orders")
    visits = orders.select(
        F.col("o_custkey").cast("string").alias("empi"),
        F.to_date("o_orderdate").alias("expdate"),
        F.col("o_orderkey").alias("p_id"),
    )
    return C.one_index_per_patient(visits)


@query
def outcome_flag(spark, sf):
    segment = FX.table(spark, sf, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("raw")
    )
    return segment.select("o_orderkey", "raw", K.outcome_flag(F.col("raw")).alias("outcome"))


@query
def index_date(spark, sf):
    customers = FX.table(spark, sf, "customer")
    offset = (F.col("c_custkey") % 1000).cast("int")
    return customers.select("c_custkey", K.index_date(offset).alias("expdate"))


@query
def sas_date(spark, sf):
    return FX.cohort(spark, sf).select("empi", "expdate", K.sas_date(F.col("expdate")).alias("sas"))


@query
def participant_keys(spark, sf):
    return C.participant_keys(FX.cohort(spark, sf))


@query
def note_coverage(spark, sf):
    return C.note_coverage(FX.notes(spark, sf))


@query
def coverage_totals(spark, sf):
    return C.coverage_totals(FX.notes(spark, sf))


@query
def no_notes(spark, sf):
    members = FX.cohort(spark, sf).select("empi", "expdate")
    return C.without_rows(members, FX.notes(spark, sf), ("empi", "expdate"))


@query
def key_census(spark, sf):
    return T.key_census(FX.mterms(spark, sf))


# --- text ---------------------------------------------------------------------


@query
def normalise_nltk(spark, sf):
    rows = N.tokenised(_window(spark, sf))
    return rows.select("note_id", "body", F.size("tokens").alias("tokens"))


@query
def normalise_raw(spark, sf):
    rows = N.tokenised(_window(spark, sf), "raw")
    return rows.select("note_id", F.array_join("tokens", " ").alias("tokens"))


@query
def normalise_topic(spark, sf):
    rows = TP.topic_tokens(_window(spark, sf))
    return rows.select("note_id", F.array_join("tokens", " ").alias("tokens"))


@query
def sentence_split(spark, sf):
    rows = E.sentence_rows(FX.notes(spark, sf).select("note_id", "text"))
    return rows.select("note_id", "position", "document")


@query
def sentence_abbreviations(spark, sf):
    """Abbreviations learned from the notes, with their scores in thousandths."""
    rows = SE.abbreviations(_window(spark, sf).select("text"))
    return rows.select("word", F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score"))


@query
def sentence_split_learned(spark, sf):
    """Sentences that do not end at a learned abbreviation."""
    notes = _window(spark, sf).select("note_id", "text")
    return SE.split(notes, scale.staged(SE.abbreviations(notes), "abbreviations"))


# --- n-grams ------------------------------------------------------------------


def _tokens(spark, sf, preprocessor="nltk", mode="signed"):
    return N.tokenised(_window(spark, sf, mode), preprocessor)


@query
def unigram_counts(spark, sf):
    return N.ngram_counts(_tokens(spark, sf), 1)


@query
def bigram_counts(spark, sf):
    return N.ngram_counts(_tokens(spark, sf), 2)


@query
def raw_unigram_counts(spark, sf):
    return N.ngram_counts(_tokens(spark, sf, "raw"), 1)


@query
def top_unigrams(spark, sf):
    return N.top_ngrams(unigram_counts(spark, sf), TOP_K)


@query
def top_bigrams(spark, sf):
    return N.top_ngrams(bigram_counts(spark, sf), TOP_K)


def _presence(spark, sf, layout, n=1, mode="signed", k=TOP_K):
    tokens = _tokens(spark, sf, mode=mode)
    return N.token_presence(tokens, n, layout, N.select_features(_tokens(spark, sf), n, k))


def _register_layouts() -> None:
    for layout in OUTPUT_ELEMENTS:
        QUERIES[f"presence_{layout}"] = lambda spark, sf, layout=layout: _presence(
            spark, sf, layout
        )


_register_layouts()


@query
def presence_abs(spark, sf):
    return _presence(spark, sf, "empi_expdate", mode="abs")


@query
def presence_bigram(spark, sf):
    return _presence(spark, sf, "empi_expdate", n=2)


@query
def presence_all(spark, sf):
    return N.token_presence(_tokens(spark, sf), 2, "empi_expdate_notetype")


@query
def presence_substring(spark, sf):
    tokens = scale.staged(_tokens(spark, sf), "tokens")
    chosen = N.select_features(tokens, 1, TOP_K)
    return N.substring_presence(tokens, 1, "empi_expdate", chosen)


@query
def presence_substring_bigram(spark, sf):
    tokens = scale.staged(_tokens(spark, sf), "tokens")
    chosen = N.select_features(tokens, 2, TOP_K)
    return N.substring_presence(tokens, 2, "empi_expdate", chosen)


@query
def feature_totals(spark, sf):
    return N.feature_totals(_presence(spark, sf, "empi_expdate"))


@query
def ngram_wide(spark, sf):
    """One row per participant over the whole vocabulary: names and spans, in name order."""
    return _shown(_ngram_rows(spark, sf))


def _ngram_rows(spark, sf):
    return M.whole(N.as_features(_presence(spark, sf, "empi_expdate"), 1))


def _shown(rows):
    spans = F.transform("values", lambda v: v.cast("long").cast("string"))
    return rows.select(
        "empi",
        "expdate",
        F.array_join("features", " ").alias("ngrams"),
        F.array_join(spans, " ").alias("spans"),
    )


@query
def ngram_attach(spark, sf):
    members = FX.cohort(spark, sf).select("empi", "expdate")
    return _shown(M.attach(members, _ngram_rows(spark, sf)))


@query
def ngram_wide_to_long(spark, sf):
    return M.whole_to_long(_ngram_rows(spark, sf))


# --- codes --------------------------------------------------------------------


def _codes(spark, sf, dimension):
    return CO.code_frequency(FX.cohort(spark, sf), FX.code_events(spark, sf), dimension)


def _register_dimensions() -> None:
    for dimension in CO.DIMENSIONS:
        QUERIES[f"code_frequency_{dimension}"] = lambda spark, sf, d=dimension: _codes(spark, sf, d)


_register_dimensions()


@query
def structured_codes(spark, sf):
    tables = PL.structured_codes(FX.cohort(spark, sf), FX.code_events(spark, sf), "claims")
    joined = tables.frequency.withColumn("code", F.concat("code", F.lit(CO.SUFFIX)))
    return joined.join(tables.binary, ["empi", "expdate", "source", "code"])


@query
def code_matrices(spark, sf):
    """Wide 0/1 columns of the claims codes, one row per cohort member."""
    return PL.code_matrices(_members(spark, sf), _codes(spark, sf, "combined"), "claims").binary


@query
def code_binary_hdec(spark, sf):
    return CO.checked_binary(CO.binary_codes(_codes(spark, sf, "combined")))


@query
def code_wide(spark, sf):
    counts = CO.codes_wide(_codes(spark, sf, "claims"))
    return M.attach(FX.cohort(spark, sf).select("empi", "expdate"), counts)


@query
def code_long(spark, sf):
    return CO.codes_long(code_wide(spark, sf))


@query
def code_checks(spark, sf):
    cells = CO.codes_long(code_wide(spark, sf))
    return CO.not_binary(cells.select(K.positive_to_one(F.col("n")).alias("value")))


@query
def code_repeats(spark, sf):
    return CO.repeated_covariates(_codes(spark, sf, "combined"))


# --- term mentions ------------------------------------------------------------


def _members(spark, sf):
    return FX.cohort(spark, sf).select("empi", "expdate")


def _mentions(spark, sf):
    return T.tagged(T.of_cohort(_members(spark, sf), FX.mterms(spark, sf)))


def _inside(spark, sf):
    """Mentions of the cohort, written without the names that are made from them, and what adds these."""
    inside = scale.staged(T.of_cohort(_members(spark, sf), FX.mterms(spark, sf)), "mentions")
    return inside, T.tagger(inside)


def _symbol_line():
    return F.concat(
        F.col("noteID").cast("string"),
        F.lit(","),
        "term",
        F.lit(" , "),
        "SNOMED_PrefTerm",
        F.lit(" - - "),
        "module",
        F.lit(" ("),
        "rxcui",
        F.lit(') 1.2.3 "'),
        "UMLS_CUI",
        F.lit("\" . , it's 5% é & "),
        "concept_id",
        F.lit("?/<>=+*~@:;\\ ,,  . ,,b"),
    )


@query
def clean_delimiters(spark, sf):
    lines = FX.mterms(spark, sf).select(_symbol_line().alias("line"))
    return lines.select("line", X.clean_delimiters(F.col("line")).alias("clean"))


@query
def clean_delimiters_literal(spark, sf):
    lines = FX.mterms(spark, sf).select(_symbol_line().alias("line"))
    clean = X.clean_delimiters(F.col("line"), literal_period=True, join_leukemia=True)
    return lines.select("line", clean.alias("clean"))


@query
def clean_header(spark, sf):
    lines = FX.mterms(spark, sf).select(_symbol_line().alias("line"))
    return lines.select("line", X.clean_delimiters(F.col("line"), header=True).alias("clean"))


@query
def clean_names(spark, sf):
    raw = F.concat("SNOMED_PrefTerm", F.lit(" isÉtatABCd 5% 'x' "), "term")
    names = FX.mterms(spark, sf).select(raw.alias("raw"))
    return names.select("raw", X.clean_name(F.col("raw")).alias("clean"))


@query
def decimal_mark(spark, sf):
    rows = FX.mterms(spark, sf)
    return rows.select("noteID", "term", X.decimal_mark(F.col("term")).alias("marked"))


@query
def concept_tags(spark, sf):
    return _mentions(spark, sf).select(
        "key", "noteID", "module", "concept_tags", "clean_concept_tags"
    )


@query
def term_names(spark, sf):
    return _mentions(spark, sf).select("key", "noteID", "module", "term_names", "clean_terms")


@query
def indicators(spark, sf):
    plain = _mentions(spark, sf).withColumns(
        {"negated_mod": F.lit(0), "family_history_mod": F.lit(0)}
    )
    return T.indicators(plain)


@query
def assertion_adjust(spark, sf):
    return T.indicators(_mentions(spark, sf))


@query
def assertion_literal(spark, sf):
    return T.indicators(_mentions(spark, sf), "literal")


def _frequency(spark, sf):
    return T.term_frequency(_members(spark, sf), FX.mterms(spark, sf))


@query
def term_frequency(spark, sf):
    return _frequency(spark, sf)


@query
def term_binary(spark, sf):
    return T.term_binary(_frequency(spark, sf))


@query
def participant_modes(spark, sf):
    inside, tag = _inside(spark, sf)
    return T.participant_modes(inside, T.mode_columns(tag(inside)), tag)


@query
def module_summary(spark, sf):
    return T.module_summary(*_inside(spark, sf))


@query
def missing_summary(spark, sf):
    return T.missing_summary(_members(spark, sf), _mentions(spark, sf))


@query
def term_demographics(spark, sf):
    return PL.term_demographics(_members(spark, sf), FX.mterms(spark, sf))


@query
def term_tables(spark, sf):
    """Saved tables with the demographics, read back by a second run."""
    path = _folder(spark, "term-tables")
    for _ in range(2):
        tables = PL.term_tables(_members(spark, sf), FX.mterms(spark, sf), path)
    keys = ["empi", "expdate", "family", "feature"]
    values = tables.binary.select(*keys, "value")
    # The files are far smaller than their rows, so Spark would take the table for one to broadcast.
    counts = tables.frequency.select(*keys, "frequency", "total_entries")
    return counts.join(values.hint("merge"), keys)


@query
def no_terms(spark, sf):
    """Members without a negated adverse event, so that some have none."""
    denied = FX.mterms(spark, sf).where("module = 'ade' AND negated_mod = 1")
    return T.no_terms(_members(spark, sf), denied)


@query
def mterms_of_group(spark, sf):
    """Rows per cohort after choosing dataset and group by path, for both datasets."""
    rows = FX.mterms(spark, sf)
    dataset = F.when(F.col("noteID") % 2 == 0, "Medicaid").otherwise("Medicare")
    group = F.concat(F.lit("/grp"), (F.col("key") % 4).cast("string"), F.lit("_terms.csv"))
    pathed = rows.withColumn("path", F.concat(F.lit("terms/"), dataset, group))
    files = [f"base/{tag}{name}/{name}/{name}.csv" for tag in ("max_", "mcr_") for name in COHORTS]
    chosen = T.select_groups(pathed, F.col("path"), files, GROUPS, DEFAULT_GROUP)
    return chosen.groupBy("dataset", "cohort").agg(F.count(F.lit(1)).alias("n"))


# --- clusters -----------------------------------------------------------------


@query
def cluster_sets(spark, sf):
    return CL.cluster_sets(FX.cluster_labels(spark, sf)).select(
        "empi", F.array_join("cluster", ",").alias("cluster"), "positive_cluster_num"
    )


@query
def cluster_onehot(spark, sf):
    sets = CL.cluster_sets(FX.cluster_labels(spark, sf))
    shown = sets.select("empi", F.to_json("cluster").alias("text"))
    parsed = shown.select("empi", P.cluster_list(F.col("text")).alias("cluster"))
    return CL.cluster_onehot(parsed, TOPICS)


@query
def cluster_vectors(spark, sf):
    """The same one-hot as sparse vectors, shown by their active positions."""
    sets = CL.cluster_sets(FX.cluster_labels(spark, sf))
    names = [str(i) for i in range(TOPICS)]
    vectors = M.indicator_vectors(sets, names, "cluster", "vector")
    dense = vectors.select("empi", vector_to_array("vector").alias("v"))
    return dense.select("empi", F.array_join(F.transform("v", lambda x: x.cast("int")), "").alias("bits"))


@query
def cluster_stats(spark, sf):
    return CL.cluster_stats(FX.cluster_labels(spark, sf))


@query
def cluster_sample(spark, sf):
    return CL.cluster_sample(FX.cluster_labels(spark, sf))


@query
def cluster_cohort(spark, sf):
    sets = CL.cluster_sets(FX.cluster_labels(spark, sf))
    kept = C.restrict_to_cohort(sets, C.washout(FX.cohort(spark, sf), 365), ("empi",))
    return kept.select("empi", F.array_join("cluster", ",").alias("cluster"))


@query
def assign_clusters(spark, sf):
    vectors = FX.vectors(spark, sf)
    labelled = FX.table(spark, sf, "embeddings").select("label", "embedding")
    centres = CL.label_centres(labelled, "label")
    return CL.assign_clusters(vectors, centres).select("vec_id", "cluster")


@query
def cluster_matrix(spark, sf):
    sets = CL.cluster_sets(FX.cluster_labels(spark, sf))
    return PL.cluster_matrix(C.washout(FX.cohort(spark, sf), 180), sets, TOPICS)


@query
def cluster_job(spark, sf):
    """The job run twice on one path: the second run loads the model."""
    path = _folder(spark, "cluster-job")
    for _ in range(2):
        sets = PL.cluster_job(FX.vectors(spark, sf), TOPICS, path)
    return sets


@query
def fit_clusters(spark, sf):
    """The cluster of each vector, and whether its centre is the nearest one by ``assign_clusters``."""
    vectors = FX.vectors(spark, sf)
    model = CL.fit_clusters(vectors, TOPICS)
    centres = CL.centre_table(spark, model.clusterCenters())
    given = CL.predicted(model, vectors).withColumnRenamed("cluster", "given")
    nearest = (F.col("given") == F.col("cluster")).alias("nearest")
    return CL.assign_clusters(given, centres).select("vec_id", "empi", "document", F.col("given").alias("cluster"), nearest)


@query
def cluster_sweep(spark, sf):
    """Cost by cluster count over the default counts, as far as there are vectors."""
    return CL.cluster_sweep(FX.vectors(spark, sf))


# --- topics -------------------------------------------------------------------


def _topic_tokens(spark, sf):
    return TP.topic_tokens(_window(spark, sf))


@query
def document_frequency(spark, sf):
    return TP.document_frequency(_topic_tokens(spark, sf))


@query
def bag_of_words(spark, sf):
    tokens = _topic_tokens(spark, sf)
    vocabulary = scale.staged(TP.document_frequency(tokens), "vocabulary")
    return TP.bag_of_words(tokens, vocabulary)


def _topic_lists(spark, sf):
    rows = FX.topic_strings(spark, sf)
    return rows.withColumn("topic_contributions", P.topic_list(F.col("topic_contributions")))


@query
def topic_parse(spark, sf):
    return TP.unnested(_topic_lists(spark, sf), ["note_id", "empi"])


@query
def topic_pivot(spark, sf):
    return TP.topic_pivot(_topic_lists(spark, sf), TOPICS, ["note_id", "empi"])


@query
def topic_row_numbers(spark, sf):
    full = _topic_lists(spark, sf).where(F.size("topic_contributions") > 0)
    return scale.numbered(full.select("note_id", "empi"), ["empi"], [F.col("note_id")], "rn", 1)


@query
def topic_max_pool(spark, sf):
    return TP.max_pool_matrix(_members(spark, sf), _topic_lists(spark, sf), TOPICS)


@query
def topic_binary(spark, sf):
    return TP.binary_matrix(topic_max_pool(spark, sf))


@query
def topic_order(spark, sf):
    rows = _topic_lists(spark, sf).select("note_id", "topic_contributions")
    flipped = F.reverse("topic_contributions")
    ordered = rows.select("note_id", P.heaviest_first(flipped).alias("t"))
    return ordered.select("note_id", P.topic_text(F.col("t")).alias("topic_contributions"))


def topic_words(tokens: DataFrame) -> DataFrame:
    """The most widespread terms, dealt to topics in turn: word lists for the measures."""
    count = COHERENCE_TOPICS * WORDS_PER_TOPIC
    widest = TP.document_frequency(tokens, keep=count)
    place = F.row_number().over(Window.orderBy(F.col("notes").desc(), "term")) - 1
    dealt = widest.select("term", place.alias("place")).select(
        "term",
        (F.col("place") % COHERENCE_TOPICS).cast("int").alias("topic"),
        (F.floor(F.col("place") / COHERENCE_TOPICS) + 1).cast("int").alias("rank"),
    )
    return scale.staged(dealt, "topic-words")


def _staged_tokens(spark, sf):
    return scale.staged(_topic_tokens(spark, sf), "topic-tokens")


def _coherence(spark, sf, measure):
    tokens = _staged_tokens(spark, sf)
    scores = CH.coherence(tokens, topic_words(tokens), measure)
    return scores.select("topic", F.round("coherence", 6).alias("coherence"))


@query
def coherence_umass(spark, sf):
    return _coherence(spark, sf, "u_mass")


@query
def coherence_uci(spark, sf):
    return _coherence(spark, sf, "c_uci")


@query
def coherence_npmi(spark, sf):
    return _coherence(spark, sf, "c_npmi")


@query
def coherence_cv(spark, sf):
    return _coherence(spark, sf, "c_v")


@query
def coherence_average(spark, sf):
    tokens = _staged_tokens(spark, sf)
    scores = CH.average(CH.coherence(tokens, topic_words(tokens), "u_mass"))
    return scores.select(F.round("coherence", 6).alias("coherence"))


def _vectors(spark, sf):
    tokens = _staged_tokens(spark, sf)
    terms = TP.vocabulary_list(TP.document_frequency(tokens))
    return tokens, terms, TP.vectorised(tokens, terms)


def _fitted(spark, sf, k=5, passes=10):
    tokens, terms, vectors = _vectors(spark, sf)
    return tokens, terms, vectors, TP.fit_topics(vectors, k, passes)


@query
def fit_topics(spark, sf):
    """The heaviest words of each topic with their weights."""
    _, terms, _, model = _fitted(spark, sf)
    return TP.topic_terms(model, terms, 20)


@query
def topic_terms(spark, sf):
    """Top words of each topic, topics ranked by coherence."""
    tokens, terms, _, model = _fitted(spark, sf)
    return PL.ranked_topics(tokens, scale.staged(TP.topic_terms(model, terms, 20), "topic-terms"))


@query
def topic_contributions(spark, sf):
    """Topics and weights of every note of the window, heaviest first."""
    _, _, vectors, model = _fitted(spark, sf)
    return TP.contributions(model, vectors)


@query
def log_perplexity(spark, sf):
    _, _, vectors = _vectors(spark, sf)
    with TP.held(vectors) as kept:
        bound = TP.log_perplexity(TP.fit_topics(kept, 5), kept)
        found = scale.staged(kept.agg(F.count(F.lit(1)).alias("notes")), "notes")
    return found.select(F.lit(5).alias("k"), "notes", F.lit(bound).alias("bound"))


@query
def topic_metrics(spark, sf):
    """The job run twice: the second run loads the model and writes the same reports."""
    path = _folder(spark, "topic-job")
    for _ in range(2):
        PL.topic_job(FX.notes(spark, sf), JobConfig(), 5, path)
    return spark.read.parquet(f"{path}/k=5/topic_metrics")



def sweep(tokens: DataFrame, counts, measure: str = "u_mass", passes: int = 10) -> DataFrame:
    """Perplexity and mean coherence of a model per topic count."""
    spark = tokens.sparkSession
    terms = TP.vocabulary_list(TP.document_frequency(tokens))
    rows = []
    with TP.held(TP.vectorised(tokens, terms)) as vectors:
        for k in counts:
            model = TP.fit_topics(vectors, k, passes)
            words = scale.staged(TP.topic_terms(model, terms), "topic-terms")
            score = CH.average(CH.coherence(tokens, words, measure)).first()["coherence"]
            rows.append((k, TP.log_perplexity(model, vectors), score))
    return spark.createDataFrame(rows, "k int, log_perplexity double, coherence double")


@query
def topic_sweep(spark, sf):
    return sweep(_staged_tokens(spark, sf), (3, 5))


# --- topics held as tables ------------------------------------------------------


def _topic_table(spark, sf):
    tokens = _staged_tokens(spark, sf)
    bag = scale.staged(TP.bag_of_words(tokens, TP.document_frequency(tokens)), "bag")
    return bag, *TT.fit(bag, TABLE_TOPICS, TABLE_STEPS)


def _micro(value):
    """Millionths, as a whole number that two engines round the same way."""
    return F.floor(value * 1e6 + 0.5).cast("long")


@query
def topic_table_terms(spark, sf):
    _, topics, _ = _topic_table(spark, sf)
    return TT.top_terms(topics).select("topic", "rank", "term", _micro(F.col("weight")).alias("micro"))


@query
def topic_table_contributions(spark, sf):
    _, _, notes = _topic_table(spark, sf)
    rows = TT.contributions(notes, TP.MIN_WEIGHT)
    return rows.select("note_id", "topic", _micro(F.col("weight")).alias("micro"))


@query
def topic_table_fold_in(spark, sf):
    """Topics of every note under the given topic table, by steps inside the note."""
    bag, topics, _ = _topic_table(spark, sf)
    rows = TT.contributions(TT.fold_in(bag, topics, TABLE_TOPICS, TABLE_STEPS), TP.MIN_WEIGHT)
    return rows.select("note_id", "topic", _micro(F.col("weight")).alias("micro"))


@query
def topic_table_perplexity(spark, sf):
    bag, topics, notes = _topic_table(spark, sf)
    rows = TT.log_perplexity(bag, topics, notes)
    return rows.select("words", _micro(F.col("bound")).alias("micro"))


# --- embeddings ---------------------------------------------------------------


@query
def embed_hashed(spark, sf):
    rows = E.hashed_embeddings(_topic_tokens(spark, sf))
    cells = scale.placed(rows, ["note_id"], F.col("embedding"), "i", "x")
    return cells.select("note_id", "i", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))


@query
def embed_word2vec(spark, sf):
    tokens = _staged_tokens(spark, sf)
    model = E.fit_word_vectors(tokens, size=16)
    return E.document_embeddings(model, tokens)


def _cells(rows):
    cells = scale.placed(rows, ["note_id"], F.col("embedding"), "i", "x")
    return cells.select("note_id", "i", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))


@query
def embed_model(spark, sf):
    """Vectors of whole notes by a model that runs in the workers."""
    rows = _topic_tokens(spark, sf).where(F.size("tokens") > 0)
    texts = rows.select("note_id", F.array_join("tokens", " ").alias("text"))
    return _cells(E.embed(texts, "text", E.hashed_model(32)))


@query
def embed_model_sentences(spark, sf):
    """Vectors of sentences by the same model."""
    rows = E.sentence_rows(_window(spark, sf).select("note_id", "text"))
    rows = rows.where(F.size(X.words(F.col("document"))) > 0)
    made = E.embed(rows, "document", E.hashed_model(16))
    return made.select("note_id", "position", _rounded(F.col("embedding")).alias("vector"))


def _rounded(vector):
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 10_000).cast("long").cast("string")), " ")


def _word_vectors(spark, sf):
    tokens = _staged_tokens(spark, sf)
    return tokens, scale.staged(RI.word_vectors(tokens, size=16), "word-vectors")


def _micros(rows, *keys):
    cells = F.transform("embedding", lambda x: _micro(x).cast("string"))
    return rows.select(*keys, F.array_join(cells, " ").alias("vector"))


@query
def embed_tokens(spark, sf):
    """The vector of each known token of a note, in millionths."""
    tokens, vectors = _word_vectors(spark, sf)
    # Vectors are shown once a word, not once a token.
    rows = RI.token_embeddings(_micros(vectors, "token"), tokens, ("note_id",))
    return rows.select("note_id", "position", "token", "vector")


@query
def embed_documents(spark, sf):
    """Mean word vector of each note, in millionths."""
    tokens, vectors = _word_vectors(spark, sf)
    return _micros(RI.document_embeddings(vectors, tokens, ("note_id",)), "note_id")


@query
def embed_sentences(spark, sf):
    """Mean word vector of each sentence, by the words of the notes."""
    _, vectors = _word_vectors(spark, sf)
    # Sums of a sentence are larger than its text, so texts are dealt out and their sentences stay.
    notes = _window(spark, sf).select("note_id", "empi", "text").repartition("note_id")
    rows = E.sentence_rows(notes)
    tokens = rows.withColumn("tokens", X.topic_tokens(F.col("document"), X.ENGLISH_STOP_WORDS))
    return RI.document_embeddings(vectors, tokens, ("note_id", "position"))


# --- sources and sinks --------------------------------------------------------


@query
def roundtrip_notes(spark, sf):
    path = _folder(spark, "notes")
    W.write_note_extract(FX.notes(spark, sf), f"{path}/car")
    return R.read_notes(spark, path).drop("note_id")


@query
def roundtrip_cohort(spark, sf):
    path = _folder(spark, "cohort")
    members = FX.cohort(spark, sf)
    for dataset in ("mcr", "max"):
        members.write.option("header", True).csv(f"{path}/{dataset}_statin")
    rows = R.read_cohort(spark, f"{path}/*", "statin", "mcr")
    return K.align_types(rows, members)


def _code_files(spark, sf) -> list[str]:
    """Counts written as wide files, one per dimension; the key column is named in capitals in one of them."""
    path = _folder(spark, "codes")
    members = FX.cohort(spark, sf)
    keyed = members.select("empi", "expdate", K.empi_indexdt(F.col("empi"), F.col("expdate")).alias("empi_indexdt"))
    files = {"claims": "mcr_codes.csv", "rpdr": "mcr_rpdr_codes.csv"}
    for dimension, name in files.items():
        counts = CO.codes_wide(_codes(spark, sf, dimension))
        wide = M.attach(keyed, counts).drop("empi", "expdate")
        named = wide.withColumnRenamed("empi_indexdt", "EMPI_INDEXDT") if dimension == "rpdr" else wide
        decimal = named.select(named.columns[0], *[F.col(f"`{c}`").cast("double").alias(c) for c in named.columns[1:]])
        decimal.write.option("header", True).csv(f"{path}/{name}")
    return [f"{path}/{n}" for n in files.values()]


@query
def roundtrip_codes(spark, sf):
    """Counts with decimals, read by one scan of all files."""
    rows = R.read_code_frequencies(spark, _code_files(spark, sf))
    return rows.where(CO.code_dimension(F.col("source"), "combined"))


@query
def code_matrices_of_files(spark, sf):
    """Wide 0/1 columns of the claims codes from files of counts, one row per cohort member."""
    counts = R.read_code_counts(spark, _code_files(spark, sf))
    return PL.code_matrices(_members(spark, sf), counts, "claims").binary



def _term_files(spark, sf) -> tuple[DataFrame, str]:
    """Mentions written as term files with all pinned columns."""
    path = _folder(spark, "mterms")
    rows = FX.mterms(spark, sf)
    full = rows.select(
        *[
            F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in MTERMS.fields
        ]
    )
    full.write.option("header", True).option("emptyValue", "").csv(path)
    return rows, path


@query
def roundtrip_mterms(spark, sf):
    rows, path = _term_files(spark, sf)
    return R.read_mterms(spark, path).select(*rows.columns)


@query
def roundtrip_raw_mterms(spark, sf):
    """The same files through the delimiter cleaner."""
    rows, path = _term_files(spark, sf)
    return R.read_raw_mterms(spark, path).select(*rows.columns)


@query
def roundtrip_terms(spark, sf):
    path = _folder(spark, "terms")
    # The frequencies are counted once for both tables.
    frequency = scale.staged(_frequency(spark, sf), "frequency")
    W.write_mterms(frequency, T.term_binary(frequency), path)
    counts = spark.read.parquet(f"{path}/frequency")
    values = spark.read.parquet(f"{path}/binary")
    return counts.join(values, ["empi", "expdate", "family", "feature"])


@query
def roundtrip_united(spark, sf):
    """Two tables with different columns read back as one."""
    path = _folder(spark, "united")
    cohort = FX.cohort(spark, sf)
    cohort.select("empi", "outcome").write.parquet(f"{path}/part=1")
    cohort.select("empi", "prior365_treatment_flag").write.parquet(f"{path}/part=2")
    rows = R.read_united(spark, path)
    return K.fill_missing(rows.select("empi", "outcome", "prior365_treatment_flag", "part"), "NA")


@query
def roundtrip_embeddings(spark, sf):
    path = _folder(spark, "embeddings")
    rows = FX.vectors(spark, sf).withColumn("shard", (F.col("vec_id") % 5).cast("int"))
    W.write_embeddings(rows, path, by=["shard"])
    read = R.read_embeddings(spark, f"{path}/shard=*", ["vec_id", "document", "embedding"])
    nested = read.withColumn("nested", F.array("embedding"))
    flat = nested.withColumn("flat", P.flat_vector(F.col("nested")))
    cells = flat.select("vec_id", "document", F.posexplode("flat").alias("place", "x"))
    return cells.withColumn("x", F.round(F.col("x").cast("double"), 4) + 0.0)


@query
def roundtrip_sentences(spark, sf):
    path = _folder(spark, "sentences")
    rows = E.sentence_rows(FX.notes(spark, sf).select("note_id", "text"))
    shards = rows.withColumn("shard", (F.col("note_id") % 4).cast("int"))
    W.write_embeddings(shards, path, W.WORD_ROWS, ["shard"])
    early = R.read_sentence_shards(spark, path, 0, 2)
    late = R.read_sentence_shards(spark, path, 2)
    return early.unionByName(late).select("note_id", "position", "document")


@query
def roundtrip_ngrams(spark, sf):
    path = _folder(spark, "ngrams")
    tokens = scale.staged(_tokens(spark, sf), "tokens")
    for n in (1, 2):
        chosen = N.select_features(tokens, n, TOP_K)
        for _ in range(2):  # a rerun replaces what it wrote before
            W.write_ngram_features(N.token_presence(tokens, n, "empi", chosen), path, n)
    return R.read_ngrams(spark, path, 1).unionByName(R.read_ngrams(spark, path, 2))


@query
def roundtrip_ngram_shards(spark, sf):
    """The whole matrix of the vocabulary as wide shards, read back as long rows."""
    path = _folder(spark, "ngram-shards")
    tokens = scale.staged(_tokens(spark, sf), "tokens")
    chosen = N.select_features(tokens, 1, TOP_K)
    rows = N.as_features(N.token_presence(tokens, 1, "empi_expdate", chosen), 1)
    W.write_ngram_shards(rows, chosen, path)
    return R.read_ngram_shards(spark, [path])


@query
def roundtrip_topics(spark, sf):
    path = _folder(spark, "topics")
    rows = _topic_lists(spark, sf)
    W.write_topic_contributions(rows, path, 150)
    W.write_topic_contributions(rows.withColumn("note_id", -F.col("note_id")), path, 1500)
    read = R.read_topic_contributions(spark, path, 150)
    return TP.unnested(read, ["note_id", "empi"])


@query
def roundtrip_topic_strings(spark, sf):
    path = _folder(spark, "topic-strings")
    lists = _topic_lists(spark, sf).select("note_id", "topic_contributions")
    rows = _window(spark, sf).join(lists, "note_id")
    W.write_topic_strings(rows, path)
    W.write_topic_lines(rows, f"{path}-lines")
    read = R.read_topic_strings(spark, path)
    return TP.unnested(read, ["empi", "expdate", "notedate", "diff", "notetype"])


@query
def roundtrip_topic_matrices(spark, sf):
    path = _folder(spark, "topic-matrices")
    pooled = topic_max_pool(spark, sf)
    W.write_topic_matrices(topic_pivot(spark, sf), pooled, TP.binary_matrix(pooled), path, TOPICS)
    return spark.read.parquet(f"{path}/k={TOPICS}/binarized")


@query
def roundtrip_clusters(spark, sf):
    path = _folder(spark, "clusters")
    sets = CL.cluster_sets(FX.cluster_labels(spark, sf))
    for _ in range(2):
        W.write_cluster_sets(sets, path, "sentence_embedding", "bert", 10)
    W.write_cluster_sets(sets.limit(0), path, "word_embedding", "glove", 100)
    read = R.read_cluster_sets(spark, path, "sentence_embedding", "bert", 10)
    return read.select("empi", F.array_join("cluster", ",").alias("cluster"), "positive_cluster_num")


@query
def roundtrip_reports(spark, sf):
    path = _folder(spark, "cluster-report")
    labels = FX.cluster_labels(spark, sf)
    W.write_cluster_report(CL.cluster_stats(labels), CL.cluster_sample(labels), path, 10)
    return spark.read.parquet(f"{path}/k=10/sample")


@query
def reuse_results(spark, sf):
    path = _folder(spark, "reuse")
    first = W.reused(spark, path, lambda: unigram_counts(spark, sf))
    again = W.reused(spark, path, lambda: first.limit(0))
    return again


@query
def reuse_by_input(spark, sf):
    """Three runs on one path: the second finds the same notes in another order, the third other notes."""
    path = _folder(spark, "reuse-input")
    notes = FX.notes(spark, sf).select("note_id", "notetype", "text")
    runs = (("first", notes), ("second", notes.orderBy(F.col("note_id").desc())), ("third", notes.where("note_id % 3 <> 0")))
    seen = []
    for run, given in runs:
        counts = given.groupBy("notetype").agg(F.count(F.lit(1)).alias("n")).withColumn("built", F.lit(run))
        table = W.reused(spark, path, lambda counts=counts: counts, [given], {"by": "notetype"})
        seen.append(scale.staged(table.withColumn("run", F.lit(run)), "reused"))
    return PL.union(seen)


@query
def reuse_models(spark, sf):
    """Clusters of the vectors by a model that was saved and loaded, the second fit being skipped."""
    path = _folder(spark, "models")
    vectors = FX.vectors(spark, sf)
    for _ in range(2):
        model = W.reused_model(spark, f"{path}/c", KMeansModel, lambda: CL.fit_clusters(vectors, 5))
    return CL.predicted(model, vectors).select("vec_id", "cluster")


# --- whole jobs ---------------------------------------------------------------


def _model_free_features(spark, sf):
    config = JobConfig(top_ngrams=TOP_K)
    members = FX.cohort(spark, sf)
    labels = FX.cluster_labels(spark, sf)
    return PL.union(
        [
            PL.ngram_features(FX.notes(spark, sf), config),
            PL.code_features(members, FX.code_events(spark, sf)),
            PL.term_features(members.select("empi", "expdate"), FX.mterms(spark, sf)),
            CL.as_features(labels, members, "cluster"),
        ]
    )


@query
def covariates_long(spark, sf):
    return _model_free_features(spark, sf)


@query
def covariate_totals(spark, sf):
    return M.matrix_size(_model_free_features(spark, sf))


@query
def covariates_sparse(spark, sf):
    rows = PL.covariates(_members(spark, sf), _model_free_features(spark, sf))
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), " ")
    return rows.select("empi", "expdate", shown("indices").alias("indices"), shown("values").alias("values"))


@query
def settings_job_ngrams(spark, sf):
    """N-grams of a job by its settings file."""
    text = '{"TASK": "STATIN", "ALGORITHM": "ngram", "NGRAMS_TO_EXTRACT": "20000", "OUTPUT_ELEMENTS": "empi_expdate"}'
    return PL.settings_job(FX.notes(spark, sf), JobConfig.from_json(text), _folder(spark, "settings"))["ngram"]


@query
def settings_job_sentences(spark, sf):
    """Sentence vectors of a job by its settings file."""
    text = '{"TASK": "STATIN", "ALGORITHM": "embedding", "EMBEDDINGS": "sentence_detector hashed"}'
    models = {"hashed": E.hashed_model(16)}
    made = PL.settings_job(FX.notes(spark, sf), JobConfig.from_json(text), _folder(spark, "settings"), models)
    rows = made["embedding"].where(F.size(X.words(F.col("text"))) > 0)
    return rows.select("note_id", "position", _rounded(F.col("embedding")).alias("vector"))


@query
def covariates_modelled(spark, sf):
    """Topic and cluster covariates from models fitted on the same data."""
    vectors = FX.vectors(spark, sf)
    return PL.union(
        [
            PL.topic_features(FX.notes(spark, sf), JobConfig(), 5),
            PL.cluster_features(FX.cohort(spark, sf), vectors, TOPICS, "sentence_cluster"),
        ]
    )
