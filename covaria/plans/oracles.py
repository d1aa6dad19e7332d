"""The same queries as DuckDB SQL over the shared test tables."""

from __future__ import annotations

# Fixed values, stated here and not taken from the package, so that a wrong constant there shows.
WHITESPACE = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
RAW_TOKEN = (
    r"[\p{L}\p{M}\p{N}_]+|"
    r"[^\p{L}\p{M}\p{N}_\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
PUNCTUATION = '!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~'
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
SYMBOL_NAMES = {'~': '_symbol_tilde_',
 '@': '_symbol_at_',
 '#': '_symbol_hash_',
 '%': '_symbol_percent_',
 '&': '_symbol_and_',
 '*': '_symbol_asterisk_',
 '(': '_symbol_open_parenthesis_',
 ')': '_symbol_close_parenthesis_',
 '+': '_symbol_plus_',
 '=': '_symbol_equals_',
 '\\': '_symbol_backslash_',
 '?': '_symbol_question_mark_',
 '/': '_symbol_forwardslash_',
 '>': '_symbol_greater_than_',
 '<': '_symbol_less_than_',
 ':': '_symbol_colon_',
 ';': '_symbol_semicolon_',
 "'": '_symbol_apostrophe_',
 '"': '_symbol_quotation_'}
HYPHEN = (" - ", " symbol_hyphen ")
SPARE_COMMA = (",,,,100_symbol_percent_taken,,,,,,,", ",,,100_symbol_percent_taken,,,,,,,")
LAYOUTS = {'empi': ('empi',),
 'empi_expdate': ('empi', 'expdate'),
 'empi_expdate_notedate': ('empi', 'expdate', 'notedate'),
 'empi_expdate_notetype': ('empi', 'expdate', 'notetype'),
 'empi_expdate_notedate_notetype': ('empi', 'expdate', 'notedate', 'notetype'),
 'empi_expdate_notedate_diff_notetype': ('empi', 'expdate', 'notedate', 'diff', 'notetype'),
 'comb_empi_expdate_notedate_diff_notetype': ('empi_exp_date', 'empi', 'expdate', 'notedate',
                                              'diff', 'notetype')}
CONCEPT_COLUMNS = {'ade': 'SNOMED_PrefTerm', 'Allergy': 'rxcui', 'Medication': 'concept_id', 'Problem': 'UMLS_CUI'}
SUMMARY_COLUMNS = {'ade': ('most_frequent_ade_concept_orig', 'most_frequent_ade_derived',
         'concept_ade_module_entries', 'most_frequent_ade_term_orig',
         'most_frequent_ade_term_derived_unclean', 'most_frequent_ade_derived_clean',
         'term_ade_module_entries'),
 'Allergy': ('most_frequent_allergy_concept_orig', 'most_frequent_allergy_concept_derived',
             'concept_allergy_module_entries', 'most_frequent_allergy_term_orig',
             'most_frequent_allergy_term_derived_unclean',
             'most_frequent_allergy_term_derived_clean', 'term_allergy_module_entries'),
 'Medication': ('most_frequent_medication_concept_orig', 'most_frequent_medication_concept_derived',
                'concept_medication_module_entries', 'most_frequent_medication_term_orig',
                'most_frequent_medication_term_derived_unclean',
                'most_frequent_medication_term_derived_clean', 'term_medication_module_entries'),
 'Problem': ('most_frequent_problem_concept_orig', 'most_frequent_problem_concept_derived',
             'concept_problem_module_entries', 'most_frequent_problem_term_orig',
             'most_frequent_problem_term_derived_unclean',
             'most_frequent_problem_term_derived_clean', 'term_problem_module_entries')}
MODE_COLUMNS = ('noteID', 'notedate', 'module', 'term', 'negated_mod', 'family_history_mod', 'concept_id',
 'SNOMED_PrefTerm', 'rxcui', 'UMLS_CUI', 'term_names', 'clean_terms', 'concept_tags',
 'clean_concept_tags')
WINDOWS = {"c_v": 110, "c_uci": 10, "c_npmi": 10}
TOP_WORDS = {"u_mass": 20, "c_v": 20, "c_uci": 5, "c_npmi": 40}
EPSILON = 1e-12
SAMPLE_TEXTS = 20
NO_BELOW, NO_ABOVE, KEEP_TERMS = 20, 0.45, 100_000
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
TOP_K = 20_000
TOPICS = 10
COHERENCE_TOPICS = 5
WORDS_PER_TOPIC = 40


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = lit(WHITESPACE)
STOP = ", ".join(lit(w) for w in STOP_WORDS)
PUNCT = lit(PUNCTUATION)


def _nested(column: str, rules) -> str:
    for old, new in rules:
        column = f"replace({column}, {lit(old)}, {lit(new)})"
    return column


def _regexes(column: str, rules) -> str:
    for pattern, new in rules:
        column = f"regexp_replace({column}, {lit(pattern)}, {lit(new)}, 'g')"
    return column


def _clean_name(column: str) -> str:
    marked = (
        "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ",
        "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy",
    )
    out = f"translate({column}, '''\"', '')"
    out = _nested(out, [("%", "_percent_"), ("#", "_number_")])
    out = f"translate({out}, {lit(marked[0])}, {lit(marked[1])})"
    out = _regexes(
        out,
        [
            ("([a-z])([A-Z])", r"\1_\2"),
            ("([A-Z])([A-Z][a-z])", r"\1_\2"),
            ("[^A-Za-z0-9]+", "_"),
            ("^_+|_+$", ""),
        ],
    )
    out = f"lower({out})"
    return f"CASE WHEN regexp_matches({out}, '^[0-9]') THEN 'x' || {out} ELSE {out} END"


def _decimal_mark(column: str) -> str:
    return f"regexp_replace({column}, '^([^.]*)\\.', '\\1_symbol_decimal_')"


def _clean_delimiters(column: str, body: bool, literal: bool = False) -> str:
    names = SYMBOL_NAMES
    if body:
        rules = [("leukemia ,", "leukemia")] if literal else []
        rules += [(" , ", " "), (", ", " "), (" ,", " "), ('"', "")]
        out = _nested(column, rules)
    else:
        out = _nested(column, [(" ", "")])
    out = _nested(out, [(s, names[s]) for s in "~@#%&*()"])
    out = _nested(out, [HYPHEN] * 2)
    out = _nested(out, [(s, names[s]) for s in "+=\\?/><:;'\""])
    out = _regexes(out, [(r" \. " if literal else " . ", "_symbol_period_")] * 2)
    out = _nested(out, [(" _symbol_period_,", "_symbol_period,")])
    out = _regexes(out, [(r"([0-9])\.([0-9])", r"\1_symbol_decimal_\2")] * 2)
    out = _regexes(out, [(r"[^\p{L}\p{N},.\-]", "_")])
    out = _nested(out, [("__", "_")] * 2)
    return _nested(out, [SPARE_COMMA] * 2)


# Views in order of dependency; a query names the ones it starts from.
VIEWS = {
    "cohort": """
SELECT CAST(c.c_custkey AS VARCHAR) AS empi, CAST(o.last_order AS DATE) AS expdate, CAST(c.c_custkey AS VARCHAR) AS p_id,
 CASE WHEN c.c_acctbal > 0 THEN '1' ELSE '0' END AS outcome,
 CASE WHEN c.c_custkey % 5 = 0 THEN 1 ELSE 0 END AS prior365_treatment_flag,
 CASE WHEN c.c_custkey % 7 = 0 THEN 1 ELSE 0 END AS prior365_comparator_flag,
 CASE WHEN c.c_custkey % 10 = 0 THEN 1 ELSE 0 END AS prior180_treatment_flag,
 CASE WHEN c.c_custkey % 14 = 0 THEN 1 ELSE 0 END AS prior180_comparator_flag
FROM customer c JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""",
    "notes": """
SELECT d.doc_id AS note_id, c.p_id, c.expdate, c.empi, c.outcome, d.source AS notetype,
 CAST(c.expdate + CAST(30 - (d.doc_id * 19) % 400 AS INT) AS DATE) AS notedate, d.text
FROM documents d JOIN cohort c ON c.empi = CAST(d.doc_id % 100 AS VARCHAR)""",
    "code_events": """
SELECT CAST(o.o_custkey AS VARCHAR) AS empi, CAST(l.l_shipdate AS DATE) AS event_date, p.p_brand AS code,
 CASE WHEN l.l_linenumber % 3 = 0 THEN 'rpdr' ELSE 'mcr' END AS source
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "mterms": """
SELECT o.o_custkey AS key, l.l_orderkey AS noteID, c.empi, c.expdate, CAST(l.l_shipdate AS DATE) AS notedate,
 CASE l.l_linenumber % 5 WHEN 0 THEN 'ade' WHEN 1 THEN 'Allergy' WHEN 2 THEN 'Medication' WHEN 3 THEN 'Problem' ELSE 'Other' END AS module,
 concat(p.p_type, ' ', CAST(p.p_size AS VARCHAR), '.5') AS term,
 CASE WHEN l.l_linenumber % 5 = 4 THEN NULL WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS negated_mod,
 CASE WHEN l.l_linestatus = 'F' AND l.l_linenumber = 1 THEN 1 ELSE 0 END AS family_history_mod,
 concat('M', CAST(p.p_size AS VARCHAR)) AS concept_id, concat('S ', p.p_brand) AS SNOMED_PrefTerm,
 CASE WHEN p.p_size % 4 = 0 THEN '' ELSE CAST(p.p_size AS VARCHAR) END AS rxcui,
 concat('C', CAST(p.p_partkey % 50 AS VARCHAR)) AS UMLS_CUI
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN cohort c ON c.empi = CAST(o.o_custkey AS VARCHAR)""",
    "vectors": """
SELECT e.vec_id, CAST(e.vec_id % 100 AS VARCHAR) AS empi, concat('sentence ', CAST(e.vec_id % 60 AS VARCHAR)) AS document, e.embedding
FROM embeddings e""",
    "cluster_labels": """
SELECT e.vec_id, CAST(e.vec_id % 100 AS VARCHAR) AS empi, concat('sentence ', CAST(e.vec_id % 60 AS VARCHAR)) AS document, e.label AS cluster
FROM embeddings e""",
    "topic_strings": """
SELECT e.vec_id AS note_id, CAST(e.vec_id % 100 AS VARCHAR) AS empi,
 CASE WHEN e.vec_id % 9 = 0 THEN '[]' ELSE concat('[(', CAST(e.label AS VARCHAR), ', 0.625), (', CAST((e.label + 3) % 10 AS VARCHAR), ', 0.25)]') END AS topic_contributions
FROM embeddings e""",
    "signed": """
SELECT *, CAST(date_diff('day', notedate, expdate) AS INTEGER) AS days FROM notes
WHERE date_diff('day', notedate, expdate) BETWEEN 0 AND 364""",
    "both_ways": """
SELECT *, CAST(date_diff('day', notedate, expdate) AS INTEGER) AS days FROM notes
WHERE abs(date_diff('day', notedate, expdate)) BETWEEN 0 AND 364""",
    "lists": r"""
SELECT note_id, empi,
 list_transform(regexp_extract_all(topic_contributions, '\(([0-9]+),', 1), lambda x: CAST(x AS INTEGER)) AS topics,
 list_transform(regexp_extract_all(topic_contributions, ', ([0-9.]+)\)', 1), lambda x: CAST(x AS DOUBLE)) AS weights
FROM topic_strings""",
    "topic_rows": "SELECT note_id, empi, unnest(topics) AS topic, unnest(weights) AS weight FROM lists",
    "sets": """
SELECT empi, list(cluster ORDER BY cluster) AS cluster, CAST(count(*) AS INTEGER) AS positive_cluster_num
FROM (SELECT DISTINCT empi, cluster FROM cluster_labels) GROUP BY empi""",
}


def _body(source: str) -> str:
    below = (
        "CASE WHEN instr(lower(text), chr(10)) > 0 "
        "THEN substr(lower(text), instr(lower(text), chr(10)) + 1) ELSE '' END"
    )
    kept = f"list_filter(regexp_split_to_array({below}, {WS}), lambda w: w <> '' AND w NOT IN ({STOP}))"
    body = f"coalesce(translate(array_to_string({kept}, ' '), {PUNCT}, ''), '')"
    return f"SELECT *, {body} AS body FROM {source}"


def _token_view(source: str) -> str:
    return (
        f"SELECT *, list_filter(regexp_split_to_array(body, {WS}), lambda w: w <> '') AS tokens "
        f"FROM ({_body(source)})"
    )


VIEWS["tokens"] = _token_view("signed")
VIEWS["tokens_both_ways"] = _token_view("both_ways")
VIEWS["raw_tokens"] = (
    f"SELECT *, regexp_extract_all(lower(text), {lit(RAW_TOKEN)}) AS tokens FROM signed"
)
VIEWS["topic_tokens"] = f"""
SELECT *, list_filter(regexp_split_to_array(translate(translate(lower(text), {PUNCT}, repeat(' ', 32)), '0123456789', ''), {WS}),
 lambda w: w <> '' AND w NOT IN ({STOP}) AND length(w) >= 3) AS tokens FROM signed"""


def _grams(source: str, n: int) -> str:
    pieces = " || ' ' || ".join(f"tokens[i + {j}]" if j else "tokens[i]" for j in range(n))
    return (
        "SELECT note_id, empi, expdate, notedate, notetype, days, "
        f"unnest(list_transform(generate_series(1, len(tokens) - {n - 1}), lambda i: {pieces})) AS ngram "
        f"FROM {source}"
    )


VIEWS["unigrams"] = _grams("tokens", 1)
VIEWS["bigrams"] = _grams("tokens", 2)
VIEWS["unigrams_both_ways"] = _grams("tokens_both_ways", 1)
VIEWS["unigram_counts"] = "SELECT ngram, count(*) AS n FROM unigrams GROUP BY ngram"
VIEWS["bigram_counts"] = "SELECT ngram, count(*) AS n FROM bigrams GROUP BY ngram"
VIEWS["top_unigrams"] = f"SELECT * FROM unigram_counts ORDER BY n DESC, ngram LIMIT {TOP_K}"
VIEWS["top_bigrams"] = f"SELECT * FROM bigram_counts ORDER BY n DESC, ngram LIMIT {TOP_K}"


def _presence(grams: str, top: str | None, layout: str) -> str:
    shown = {
        "diff": "abs(days) AS diff",
        "empi_exp_date": "empi || strftime(expdate, '%m%d%Y') AS empi_exp_date",
    }
    keys = ", ".join(LAYOUTS[layout])
    columns = ", ".join(shown.get(c, c) for c in LAYOUTS[layout])
    order = "notedate DESC, note_id" if layout == "empi" else "notedate, note_id"
    only = f"WHERE ngram IN (SELECT ngram FROM {top})" if top else ""
    return (
        f"SELECT {keys}, ngram, span FROM (SELECT {columns}, ngram, abs(days) AS span, "
        f"row_number() OVER (PARTITION BY {', '.join(LAYOUTS[layout])}, ngram ORDER BY {order}) AS rn "
        f"FROM {grams} {only}) WHERE rn = 1"
        if not {"diff", "empi_exp_date"} & set(LAYOUTS[layout])
        else f"SELECT DISTINCT {columns}, ngram, abs(days) AS span FROM {grams} {only}"
    )


VIEWS["presence_empi_expdate"] = _presence("unigrams", "top_unigrams", "empi_expdate")
VIEWS["presence_bigram"] = _presence("bigrams", "top_bigrams", "empi_expdate")
VIEWS["words_in_body"] = """
SELECT DISTINCT empi, expdate, days, unnest(string_split(body, ' ')) AS chunk FROM tokens"""
VIEWS["chunk_pieces"] = """
SELECT DISTINCT chunk, unnest(flatten(list_transform(generate_series(1, length(chunk)),
 lambda i: list_transform(generate_series(1, length(chunk) - i + 1), lambda j: substr(chunk, i, j))))) AS ngram
FROM (SELECT DISTINCT chunk FROM words_in_body)"""
VIEWS["chunk_features"] = "SELECT p.chunk, t.ngram FROM chunk_pieces p JOIN top_unigrams t ON p.ngram = t.ngram"
VIEWS["chunk_pairs"] = """
SELECT DISTINCT empi, expdate, days, w[i] AS a, w[i + 1] AS b
FROM (SELECT empi, expdate, days, w, unnest(generate_series(1, len(w) - 1)) AS i
 FROM (SELECT empi, expdate, days, string_split(body, ' ') AS w FROM tokens))"""
VIEWS["pair_pieces"] = """
SELECT a, b, x, unnest(list_transform(generate_series(1, length(b)), lambda j: substr(b, 1, j))) AS y
FROM (SELECT a, b, unnest(list_transform(generate_series(1, length(a)), lambda j: substr(a, j))) AS x
 FROM (SELECT DISTINCT a, b FROM chunk_pairs))"""
VIEWS["pair_features"] = """
SELECT p.a, p.b, t.ngram FROM pair_pieces p JOIN top_bigrams t ON t.ngram = p.x || ' ' || p.y"""

VIEWS["codes"] = """
SELECT c.empi, c.expdate, e.source, e.code, count(*) AS n FROM cohort c JOIN code_events e
 ON c.empi = e.empi AND e.event_date BETWEEN c.expdate - 365 AND c.expdate GROUP BY ALL"""
VIEWS["code_wide"] = (
    "SELECT c.empi, c.expdate, "
    + ", ".join(f"CAST(sum(n) FILTER (code = {lit(b)}) AS BIGINT) AS \"{b}\"" for b in BRANDS)
    + " FROM cohort c LEFT JOIN (SELECT * FROM codes WHERE source = 'mcr') f"
    " ON c.empi = f.empi AND c.expdate = f.expdate GROUP BY c.empi, c.expdate"
)

_concept = "CASE module " + " ".join(
    f"WHEN {lit(m)} THEN 'concept_' || coalesce({c}, 'NA')" for m, c in CONCEPT_COLUMNS.items()
) + " ELSE 'NA' END"
VIEWS["tagged"] = f"""
SELECT *, {_clean_name('term_names')} AS clean_terms, {_clean_name('concept_tags')} AS clean_concept_tags
FROM (SELECT *, {_decimal_mark("('term_' || module || '_' || term)")} AS term_names,
 CASE WHEN {_concept} = 'concept_' THEN 'concept_NA' ELSE {_concept} END AS concept_tags FROM mterms)"""


def _indicators(value: str) -> str:
    return (
        "SELECT empi, expdate, 'term' AS family, clean_terms AS feature, "
        f"{value.format(clean='clean_terms', raw='term_names')} AS indicator FROM tagged UNION ALL "
        "SELECT empi, expdate, 'concept', clean_concept_tags, "
        f"{value.format(clean='clean_concept_tags', raw='concept_tags')} FROM tagged"
    )


_denied = "(family_history_mod > 0 OR negated_mod > 0)"
ADJUSTED = (
    "CASE WHEN right({clean}, 3) = '_na' THEN 1 "
    f"WHEN {_denied} THEN 0 WHEN {_denied} IS NULL THEN NULL ELSE 1 END"
)
LITERAL = (
    "CASE WHEN right({clean}, 3) = '_na' THEN 1 "
    f"WHEN ({{raw}} = {{clean}}) AND {_denied} THEN 0 "
    f"WHEN (({{raw}} = {{clean}}) AND {_denied}) IS NULL THEN NULL ELSE 1 END"
)
VIEWS["indicators"] = _indicators(ADJUSTED)
VIEWS["without_terms"] = "SELECT empi, expdate FROM cohort EXCEPT SELECT empi, expdate FROM mterms"
VIEWS["term_frequency"] = """
SELECT empi, expdate, family, feature, CAST(sum(coalesce(indicator, 0)) AS BIGINT) AS frequency
FROM indicators GROUP BY ALL
UNION ALL SELECT empi, expdate, 'term', 'term_na', 1 FROM without_terms
UNION ALL SELECT empi, expdate, 'concept', 'concept_na', 1 FROM without_terms"""
VIEWS["term_binary"] = """
SELECT empi, expdate, family, feature, CAST(CASE WHEN frequency > 0 THEN 1 ELSE frequency END AS BIGINT) AS value
FROM term_frequency"""


def _mode(column: str, source: str, extra: str = "", name: str = "v") -> str:
    return (
        f"SELECT empi, expdate{extra}, v AS {name} FROM (SELECT empi, expdate{extra}, {column} AS v, "
        f"row_number() OVER (PARTITION BY empi, expdate{extra} ORDER BY count(*) DESC, {column} NULLS FIRST) AS rn "
        f"FROM {source} GROUP BY empi, expdate{extra}, {column}) WHERE rn = 1"
    )


def _participant_modes() -> str:
    first, *rest = MODE_COLUMNS
    joins = " ".join(
        f"JOIN ({_mode(c, 'tagged', name=c)}) t{i} USING (empi, expdate)"
        for i, c in enumerate(rest)
    )
    return f"SELECT * FROM ({_mode(first, 'tagged', name=first)}) t {joins}"


def _module_summary() -> str:
    base = "SELECT DISTINCT empi, expdate FROM tagged WHERE module IN ('ade', 'Allergy', 'Medication', 'Problem')"
    joins, columns = [], []
    for i, (module, names) in enumerate(SUMMARY_COLUMNS.items()):
        rows = f"(SELECT * FROM tagged WHERE module = {lit(module)})"
        wanted = (
            (CONCEPT_COLUMNS[module], names[0]),
            ("clean_concept_tags", names[1]),
            ("term", names[3]),
            ("term_names", names[4]),
            ("clean_terms", names[5]),
        )
        for j, (column, name) in enumerate(wanted):
            joins.append(f"LEFT JOIN ({_mode(column, rows)}) m{i}_{j} USING (empi, expdate)")
            columns.append(f"m{i}_{j}.v AS {name}")
        joins.append(
            f"LEFT JOIN (SELECT empi, expdate, count(*) AS n FROM {rows} GROUP BY ALL) n{i} USING (empi, expdate)"
        )
        columns += [f"n{i}.n AS {names[2]}", f"n{i}.n AS {names[6]}"]
    return f"SELECT b.empi, b.expdate, {', '.join(columns)} FROM ({base}) b {' '.join(joins)}"


VIEWS["term_notes"] = """
SELECT term, count(*) AS notes FROM (SELECT DISTINCT note_id, unnest(tokens) AS term FROM topic_tokens) GROUP BY term"""
VIEWS["document_frequency"] = f"""
SELECT term, notes FROM term_notes
WHERE notes >= {NO_BELOW} AND notes <= (SELECT count(*) FROM topic_tokens) * CAST({NO_ABOVE} AS DOUBLE)
ORDER BY notes DESC, term LIMIT {KEEP_TERMS}"""
VIEWS["words"] = f"""
SELECT term, CAST((rn - 1) % {COHERENCE_TOPICS} AS INTEGER) AS topic, CAST((rn - 1) // {COHERENCE_TOPICS} + 1 AS INTEGER) AS rank
FROM (SELECT term, row_number() OVER (ORDER BY notes DESC, term) AS rn FROM document_frequency)
WHERE rn <= {COHERENCE_TOPICS * WORDS_PER_TOPIC}"""
VIEWS["places"] = """
SELECT note_id, len(tokens) AS n, unnest(generate_series(1, len(tokens))) - 1 AS pos, unnest(tokens) AS term FROM topic_tokens"""


def _coherence(measure: str, score: str) -> str:
    """Brute force: list every window that holds a topic word, then count."""
    w = WINDOWS.get(measure)
    top = TOP_WORDS[measure]
    if w is None:
        seen = "SELECT DISTINCT note_id, 0 AS s, term FROM places WHERE term IN (SELECT term FROM best)"
        total = "SELECT count(*) FILTER (len(tokens) > 0) AS total FROM topic_tokens"
    else:
        seen = (
            "SELECT DISTINCT note_id, s, term FROM (SELECT note_id, term, "
            f"unnest(generate_series(greatest(pos - {w - 1}, 0), least(pos, greatest(n - {w}, 0)))) AS s "
            "FROM places WHERE term IN (SELECT term FROM best))"
        )
        total = (
            f"SELECT sum(CASE WHEN len(tokens) > 0 THEN greatest(len(tokens) - {w - 1}, 1) ELSE 0 END) AS total "
            "FROM topic_tokens"
        )
    return f"""best AS (SELECT * FROM words WHERE rank <= {top}),
seen AS ({seen}),
total AS (SELECT CAST(total AS DOUBLE) AS total FROM ({total})),
ones AS (SELECT term, count(*) AS n FROM seen GROUP BY term),
twos AS (SELECT x.topic, a.term AS t1, b.term AS t2, count(*) AS n FROM seen a JOIN best x ON a.term = x.term
 JOIN seen b ON a.note_id = b.note_id AND a.s = b.s JOIN best y ON b.term = y.term AND x.topic = y.topic
 WHERE x.rank > y.rank GROUP BY ALL),
pairs AS (SELECT x.topic, x.term AS t1, y.term AS t2, coalesce(o1.n, 0) AS n1, coalesce(o2.n, 0) AS n2,
 coalesce(t.n, 0) AS n_both, total FROM best x JOIN best y ON x.topic = y.topic AND x.rank > y.rank
 LEFT JOIN ones o1 ON o1.term = x.term LEFT JOIN ones o2 ON o2.term = y.term
 LEFT JOIN twos t ON t.topic = x.topic AND t.t1 = x.term AND t.t2 = y.term, total),
scored AS (SELECT topic, t1, t2, {score} AS score FROM pairs),
"""


_JOINT = f"(n_both / total + {EPSILON!r})"
UMASS = f"CASE WHEN n2 = 0 THEN 0.0 ELSE ln({_JOINT} / (n2 / total)) END"
PMI = f"CASE WHEN n1 = 0 OR n2 = 0 THEN 0.0 ELSE ln({_JOINT} / ((n1 / total) * (n2 / total))) END"
NPMI = f"CASE WHEN {_JOINT} >= 1 THEN 1.0 ELSE {PMI} / -ln({_JOINT}) END"
MEAN = "means AS (SELECT topic, avg(score) AS coherence FROM scored GROUP BY topic)"
COSINE = """cells AS (SELECT * FROM scored UNION ALL SELECT topic, t2, t1, score FROM scored
 UNION ALL SELECT topic, term, term, 1.0 FROM best),
sums AS (SELECT topic, t2, sum(score) AS total FROM cells GROUP BY ALL),
cosines AS (SELECT c.topic, c.t1, sum(score * s.total) / (sqrt(sum(score * score)) * sqrt(sum(s.total * s.total))) AS x
 FROM cells c JOIN sums s ON c.topic = s.topic AND c.t2 = s.t2 GROUP BY ALL),
means AS (SELECT topic, avg(x) AS coherence FROM cosines GROUP BY topic)"""
ROUNDED = "SELECT topic, round(coherence, 6) AS coherence FROM means"


def sql(select: str, *views: str, extra: str = "") -> str:
    """A query with the named views, and those they use, as common table expressions."""
    wanted: set[str] = set()
    names = list(VIEWS)
    words = set(views)
    for name in reversed(names):
        if name in words:
            wanted.add(name)
            words |= {n for n in names if n != name and _mentions(VIEWS[name], n)}
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names if n in wanted]
    if extra:
        parts.append(extra)
    return f"WITH {', '.join(parts)} {select}"


def _mentions(text: str, name: str) -> bool:
    padded = f" {text} ".replace("\n", " ").replace("(", " ").replace(")", " ").replace(",", " ")
    return f" FROM {name} " in padded or f" JOIN {name} " in padded


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    everything = "SELECT * FROM {0}"

    def view(name: str, source: str | None = None) -> None:
        out[name] = sql(everything.format(source or name), source or name)

    out["cohort_notes_join"] = sql(
        "SELECT n.note_id, c.empi, c.expdate, n.notedate, n.notetype, CAST(length(n.text) AS INTEGER) AS chars "
        "FROM notes n JOIN cohort c ON n.empi = c.empi AND n.notedate BETWEEN c.expdate - 365 AND c.expdate",
        "cohort",
        "notes",
    )
    days = "SELECT note_id, empi, expdate, notedate, days FROM "
    out["note_window_signed"] = sql(days + "signed", "signed")
    out["note_window_abs"] = sql(days + "both_ways", "both_ways")
    out["note_flatten"] = sql(
        "SELECT empi, expdate, notedate, days AS diffdays, notetype, outcome AS \"Outcome\", "
        "row_number() OVER (PARTITION BY empi, expdate ORDER BY notedate DESC, note_id) - 1 AS note_number, text FROM signed",
        "signed",
    )
    washed = (
        "SELECT empi, expdate, p_id, outcome, prior365_treatment_flag, prior365_comparator_flag, "
        "prior180_treatment_flag, prior180_comparator_flag FROM cohort"
    )
    for name, rule in {
        "washout_365": " WHERE prior365_treatment_flag = 0 AND prior365_comparator_flag = 0",
        "washout_180": " WHERE prior180_treatment_flag = 0 AND prior180_comparator_flag = 0",
        "washout_repeated": " WHERE prior365_treatment_flag = 0",
        "washout_none": "",
    }.items():
        out[name] = sql(washed + rule, "cohort")
    out["first_index_date"] = (
        "SELECT empi, expdate, p_id FROM (SELECT CAST(o_custkey AS VARCHAR) AS empi, CAST(o_orderdate AS DATE) AS expdate, "
        "o_orderkey AS p_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS rn "
        "FROM orders) WHERE rn = 1"
    )
    out["outcome_flag"] = (
        "SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS raw, "
        "CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN '1' ELSE '0' END AS outcome FROM orders"
    )
    out["index_date"] = (
        "SELECT c_custkey, CAST(DATE '2007-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS DATE) AS expdate FROM customer"
    )
    sas = "CAST(date_diff('day', DATE '1960-01-01', expdate) AS INTEGER)"
    out["sas_date"] = sql(f"SELECT empi, expdate, {sas} AS sas FROM cohort", "cohort")
    out["participant_keys"] = sql(
        f"SELECT empi, expdate, {sas} AS sas_date, empi || CAST({sas} AS VARCHAR) AS empi_indexdt, "
        "empi || strftime(expdate, '%m%d%Y') AS empi_exp_date FROM cohort",
        "cohort",
    )
    inside = "abs(date_diff('day', notedate, expdate)) < 365"
    out["note_coverage"] = sql(
        f"SELECT empi, count(*) AS notes, count(*) FILTER ({inside}) AS notes_in_window FROM notes GROUP BY empi",
        "notes",
    )
    out["coverage_totals"] = sql(
        f"SELECT count(DISTINCT empi) AS patients_with_note, count(DISTINCT empi) FILTER ({inside}) AS patients_in_window, "
        f"count(*) FILTER ({inside}) AS notes_in_window FROM notes",
        "notes",
    )
    out["no_notes"] = sql(
        "SELECT empi, expdate FROM cohort EXCEPT SELECT empi, expdate FROM notes", "cohort", "notes"
    )
    out["key_census"] = sql(
        "SELECT key, expdate, count(*) AS n FROM mterms GROUP BY key, expdate", "mterms"
    )

    out["normalise_nltk"] = sql(
        "SELECT note_id, body, CAST(len(tokens) AS INTEGER) AS tokens FROM tokens", "tokens"
    )
    joined = "SELECT note_id, coalesce(array_to_string(tokens, ' '), '') AS tokens FROM "
    out["normalise_raw"] = sql(joined + "raw_tokens", "raw_tokens")
    out["normalise_topic"] = sql(joined + "topic_tokens", "topic_tokens")
    cut = f"string_split(regexp_replace(text, '([.!?])' || {WS}, '\\1' || chr(1), 'g'), chr(1))"
    sentences = (
        "SELECT note_id, CAST(position AS INTEGER) AS position, document FROM (SELECT note_id, "
        f"unnest(generate_series(0, len({cut}) - 1)) AS position, unnest({cut}) AS document FROM notes) "
        "WHERE trim(document, ' ') <> ''"
    )
    out["sentence_split"] = sql(sentences, "notes")

    for name in ("unigram_counts", "bigram_counts", "top_unigrams", "top_bigrams"):
        view(name)
    out["raw_unigram_counts"] = sql(
        "SELECT ngram, count(*) AS n FROM (SELECT unnest(tokens) AS ngram FROM raw_tokens) GROUP BY ngram",
        "raw_tokens",
    )
    for layout in LAYOUTS:
        out[f"presence_{layout}"] = sql(
            _presence("unigrams", "top_unigrams", layout), "unigrams", "top_unigrams"
        )
    out["presence_abs"] = sql(
        _presence("unigrams_both_ways", "top_unigrams", "empi_expdate"),
        "unigrams_both_ways",
        "top_unigrams",
    )
    view("presence_bigram")
    out["presence_all"] = sql(_presence("bigrams", None, "empi_expdate_notetype"), "bigrams")
    found = "SELECT empi, expdate, f.ngram, max(days) AS span FROM "
    out["presence_substring"] = sql(
        found + "words_in_body w JOIN chunk_features f ON w.chunk = f.chunk GROUP BY ALL",
        "words_in_body",
        "chunk_features",
    )
    out["presence_substring_bigram"] = sql(
        found + "chunk_pairs w JOIN pair_features f ON w.a = f.a AND w.b = f.b GROUP BY ALL",
        "chunk_pairs",
        "pair_features",
    )
    out["feature_totals"] = sql(
        "SELECT count(DISTINCT empi) AS patients, count(*) AS features FROM presence_empi_expdate",
        "presence_empi_expdate",
    )
    whole = (
        "SELECT empi, expdate, string_agg(ngram, ' ' ORDER BY ngram) AS ngrams, "
        "string_agg(CAST(span AS VARCHAR), ' ' ORDER BY ngram) AS spans FROM presence_empi_expdate GROUP BY ALL"
    )
    out["ngram_wide"] = sql(whole, "presence_empi_expdate")
    out["ngram_attach"] = sql(
        f"SELECT c.empi, c.expdate, w.ngrams, w.spans FROM cohort c LEFT JOIN ({whole}) w "
        "ON c.empi = w.empi AND c.expdate = w.expdate",
        "cohort",
        "presence_empi_expdate",
    )
    out["ngram_wide_to_long"] = sql(
        "SELECT empi, expdate, ngram AS feature, CAST(span AS DOUBLE) AS value FROM presence_empi_expdate",
        "presence_empi_expdate",
    )

    out["code_frequency_claims"] = sql("SELECT * FROM codes WHERE source = 'mcr'", "codes")
    out["code_frequency_rpdr"] = sql("SELECT * FROM codes WHERE source = 'rpdr'", "codes")
    out["code_frequency_combined"] = sql("SELECT * FROM codes", "codes")
    out["structured_codes"] = sql(
        "SELECT empi, expdate, source, code || '_hdec' AS code, n, 1 AS value FROM codes WHERE source = 'mcr'",
        "codes",
    )
    flags = ", ".join(f"max(CASE WHEN code = {lit(b)} THEN 1 END) AS \"{b}_hdec\"" for b in BRANDS)
    out["code_matrices"] = sql(
        f"SELECT c.empi, c.expdate, {flags} FROM cohort c LEFT JOIN (SELECT * FROM codes WHERE source = 'mcr') f "
        "ON c.empi = f.empi AND c.expdate = f.expdate GROUP BY c.empi, c.expdate",
        "cohort",
        "codes",
    )
    out["code_matrices_of_files"] = out["code_matrices"]
    out["code_binary_hdec"] = sql(
        "SELECT empi, expdate, source, code || '_hdec' AS code, 1 AS value FROM codes", "codes"
    )
    view("code_wide")
    members = "SELECT c.empi, c.expdate, b.code, {0} AS n FROM cohort c CROSS JOIN brands b LEFT JOIN codes f ON "
    members += "c.empi = f.empi AND c.expdate = f.expdate AND f.code = b.code AND f.source = 'mcr'"
    brands = "brands AS (SELECT unnest([" + ", ".join(lit(b) for b in BRANDS) + "]) AS code)"
    out["code_long"] = sql(members.format("f.n"), "cohort", "codes", extra=brands)
    out["code_checks"] = sql(
        "SELECT count(*) FILTER (n IS NULL) AS not_binary, count(*) AS checked FROM ("
        + members.format("f.n")
        + ")",
        "cohort",
        "codes",
        extra=brands,
    )
    out["code_repeats"] = sql(
        "SELECT empi, expdate, code, count(*) AS listed FROM codes GROUP BY ALL HAVING count(*) > 1",
        "codes",
    )

    line = (
        "concat(CAST(noteID AS VARCHAR), ',', term, ' , ', SNOMED_PrefTerm, ' - - ', module, ' (', rxcui, "
        "') 1.2.3 \"', UMLS_CUI, '\" . , it''s 5% é & ', concept_id, '?/<>=+*~@:;\\ ,,  . ,,b')"
    )
    for name, clean in {
        "clean_delimiters": _clean_delimiters("line", True),
        "clean_delimiters_literal": _clean_delimiters("line", True, True),
        "clean_header": _clean_delimiters("line", False),
    }.items():
        out[name] = sql(f"SELECT line, {clean} AS clean FROM (SELECT {line} AS line FROM mterms)", "mterms")
    out["clean_names"] = sql(
        f"SELECT raw, {_clean_name('raw')} AS clean FROM "
        "(SELECT SNOMED_PrefTerm || ' isÉtatABCd 5% ''x'' ' || term AS raw FROM mterms)",
        "mterms",
    )
    out["decimal_mark"] = sql(
        f"SELECT noteID, term, {_decimal_mark('term')} AS marked FROM mterms", "mterms"
    )
    out["concept_tags"] = sql(
        "SELECT key, noteID, module, concept_tags, clean_concept_tags FROM tagged", "tagged"
    )
    out["term_names"] = sql("SELECT key, noteID, module, term_names, clean_terms FROM tagged", "tagged")
    out["indicators"] = sql(_indicators("1"), "tagged")
    out["assertion_adjust"] = sql("SELECT * FROM indicators", "indicators")
    out["assertion_literal"] = sql(_indicators(LITERAL), "tagged")
    view("term_frequency")
    view("term_binary")
    out["participant_modes"] = sql(_participant_modes(), "tagged")
    out["module_summary"] = sql(_module_summary(), "tagged")
    missing = (
        "SELECT c.empi, c.expdate, missing_concept, coalesce(missing_term, 1) AS missing_term, "
        "coalesce(total_entries, 0) AS total_entries FROM cohort c LEFT JOIN (SELECT empi, expdate, "
        "count(*) FILTER (clean_concept_tags = 'concept_na') AS missing_concept, "
        "count(*) FILTER (clean_terms = 'term_na') AS missing_term, count(*) AS total_entries "
        "FROM tagged GROUP BY ALL) t ON c.empi = t.empi AND c.expdate = t.expdate"
    )
    out["missing_summary"] = sql(missing, "cohort", "tagged")
    out["term_demographics"] = sql(
        f"SELECT * FROM ({missing}) LEFT JOIN ({_participant_modes()}) USING (empi, expdate) "
        f"LEFT JOIN ({_module_summary()}) USING (empi, expdate)",
        "cohort",
        "tagged",
    )
    out["no_terms"] = sql(
        "SELECT empi, expdate FROM cohort EXCEPT SELECT empi, expdate FROM mterms WHERE module = 'ade' AND negated_mod = 1",
        "cohort",
        "mterms",
    )
    out["term_tables"] = sql(
        "SELECT f.*, coalesce(t.n, 0) AS total_entries, CASE WHEN frequency > 0 THEN 1 ELSE frequency END AS value "
        "FROM term_frequency f LEFT JOIN (SELECT empi, expdate, count(*) AS n FROM tagged GROUP BY ALL) t "
        "ON f.empi = t.empi AND f.expdate = t.expdate",
        "term_frequency",
        "tagged",
    )
    # Groups 0 and 1 of the Medicaid files, 1 and 2 of the Medicare ones; the third cohort takes group 3.
    out["mterms_of_group"] = sql(
        "SELECT g.dataset, g.cohort, count(*) AS n FROM (VALUES ('Medicaid', 'cohort1', 0), ('Medicaid', 'cohort2', 1), "
        "('Medicaid', 'cohort3', 3), ('Medicare', 'cohort1', 1), ('Medicare', 'cohort2', 2), ('Medicare', 'cohort3', 3)) "
        "g(dataset, cohort, part) JOIN mterms ON key % 4 = g.part "
        "AND g.dataset = CASE WHEN noteID % 2 = 0 THEN 'Medicaid' ELSE 'Medicare' END GROUP BY ALL",
        "mterms",
    )

    shown = "SELECT empi, array_to_string(cluster, ',') AS cluster"
    out["cluster_sets"] = sql(shown + ", positive_cluster_num FROM sets", "sets")
    bits = [f"CAST(list_contains(cluster, {i}) AS INTEGER)" for i in range(TOPICS)]
    out["cluster_onehot"] = sql(
        "SELECT empi, " + ", ".join(f"{b} AS Cluster_ID_{i}" for i, b in enumerate(bits)) + " FROM sets",
        "sets",
    )
    out["cluster_matrix"] = sql(
        "SELECT empi, " + ", ".join(f"{b} AS Cluster_ID_{i}" for i, b in enumerate(bits)) + " FROM sets "
        "WHERE empi IN (SELECT empi FROM cohort WHERE prior180_treatment_flag = 0 AND prior180_comparator_flag = 0)",
        "sets",
        "cohort",
    )
    out["cluster_vectors"] = sql(
        "SELECT empi, " + " || ".join(f"CAST({b} AS VARCHAR)" for b in bits) + " AS bits FROM sets",
        "sets",
    )
    out["cluster_stats"] = sql(
        "SELECT cluster, count(DISTINCT document) AS texts, count(*) AS rows FROM cluster_labels GROUP BY cluster",
        "cluster_labels",
    )
    sample = (
        "SELECT * FROM (SELECT cluster, document, CAST(row_number() OVER (PARTITION BY cluster ORDER BY document) AS INTEGER) AS position "
        f"FROM (SELECT DISTINCT cluster, document FROM cluster_labels)) WHERE position <= {SAMPLE_TEXTS}"
    )
    out["cluster_sample"] = sql(sample, "cluster_labels")
    out["cluster_cohort"] = sql(
        shown + " FROM sets WHERE empi IN (SELECT empi FROM cohort WHERE prior365_treatment_flag = 0 "
        "AND prior365_comparator_flag = 0)",
        "sets",
        "cohort",
    )
    out["assign_clusters"] = (
        "WITH cells AS (SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS i, "
        "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), "
        "centres AS (SELECT label, i, round(avg(x), 3) AS c FROM cells GROUP BY label, i), "
        "gaps AS (SELECT v.vec_id, c.label, sum((v.x - c.c) * (v.x - c.c)) AS gap FROM cells v "
        "JOIN centres c ON v.i = c.i GROUP BY v.vec_id, c.label) "
        "SELECT vec_id, arg_min(label, gap) AS cluster FROM gaps GROUP BY vec_id"
    )

    view("document_frequency")
    out["bag_of_words"] = sql(
        "SELECT note_id, term, count(*) AS tf FROM (SELECT note_id, unnest(tokens) AS term FROM topic_tokens) "
        "WHERE term IN (SELECT term FROM document_frequency) GROUP BY note_id, term",
        "topic_tokens",
        "document_frequency",
    )
    view("topic_parse", "topic_rows")
    names = [f"topic_contributions_{i}" for i in range(TOPICS)]
    pivot = ", ".join(
        f"coalesce(max(weight) FILTER (topic = {i}), 0.0) AS {n}" for i, n in enumerate(names)
    )
    pivoted = f"SELECT note_id, empi, {pivot} FROM topic_rows GROUP BY note_id, empi"
    out["topic_pivot"] = sql(pivoted, "topic_rows")
    pooled = (
        f"SELECT c.empi, c.expdate, {pivot} FROM cohort c LEFT JOIN topic_rows t ON c.empi = t.empi "
        "GROUP BY c.empi, c.expdate"
    )
    out["topic_max_pool"] = sql(pooled, "cohort", "topic_rows")
    binary = ", ".join(f"CAST({n} <> 0 AS INTEGER) AS {n}" for n in names)
    binary = f"SELECT empi, expdate, {binary} FROM ({pooled})"
    out["topic_binary"] = sql(binary, "cohort", "topic_rows")
    out["topic_row_numbers"] = sql(
        "SELECT note_id, empi, row_number() OVER (PARTITION BY empi ORDER BY note_id) AS rn FROM lists WHERE len(topics) > 0",
        "lists",
    )
    out["topic_order"] = sql("SELECT note_id, topic_contributions FROM topic_strings", "topic_strings")

    used = ("words", "places", "topic_tokens")
    out["coherence_umass"] = sql(ROUNDED, *used, extra=_coherence("u_mass", UMASS) + MEAN)
    out["coherence_uci"] = sql(ROUNDED, *used, extra=_coherence("c_uci", PMI) + MEAN)
    out["coherence_npmi"] = sql(ROUNDED, *used, extra=_coherence("c_npmi", NPMI) + MEAN)
    out["coherence_cv"] = sql(ROUNDED, *used, extra=_coherence("c_v", NPMI) + COSINE)
    out["coherence_average"] = sql(
        "SELECT round(avg(coherence), 6) AS coherence FROM means",
        *used,
        extra=_coherence("u_mass", UMASS) + MEAN,
    )

    out["embed_hashed"] = sql(
        "SELECT note_id, CAST(i - 1 AS INTEGER) AS i, round(CAST(CAST(sum(n * (2 * strpos('0123456789abcdef', substr(h, i, 1)) - 17)) / (sum(n) * 15.0) AS FLOAT) AS DOUBLE), 4) + 0.0 AS x "
        "FROM (SELECT note_id, term, count(*) AS n, md5(term || '#0') AS h FROM places GROUP BY note_id, term), "
        "(SELECT unnest(generate_series(1, 32)) AS i) GROUP BY note_id, i",
        "places",
    )

    out["roundtrip_notes"] = sql(
        "SELECT p_id, expdate, empi, outcome, notetype, notedate, text FROM notes", "notes"
    )
    out["roundtrip_cohort"] = sql("SELECT * FROM cohort", "cohort")
    out["roundtrip_codes"] = sql(
        f"SELECT empi || CAST({sas} AS VARCHAR) AS empi_indexdt, code, n, "
        "CASE source WHEN 'mcr' THEN 'mcr_codes.csv' ELSE 'mcr_rpdr_codes.csv' END AS source FROM codes",
        "codes",
    )
    out["roundtrip_mterms"] = sql(
        "SELECT * EXCLUDE (empi) REPLACE (nullif(rxcui, '') AS rxcui, CAST(negated_mod AS BIGINT) AS negated_mod, "
        "CAST(family_history_mod AS BIGINT) AS family_history_mod) FROM mterms",
        "mterms",
    )
    cleaned = ", ".join(
        f"nullif({_clean_delimiters(c, True)}, '') AS {c}"
        for c in ("module", "term", "concept_id", "SNOMED_PrefTerm", "rxcui", "UMLS_CUI")
    )
    out["roundtrip_raw_mterms"] = sql(
        f"SELECT * EXCLUDE (empi) REPLACE ({cleaned}, CAST(negated_mod AS BIGINT) AS negated_mod, "
        "CAST(family_history_mod AS BIGINT) AS family_history_mod) FROM mterms",
        "mterms",
    )
    out["roundtrip_terms"] = sql(
        "SELECT *, CASE WHEN frequency > 0 THEN 1 ELSE frequency END AS value FROM term_frequency", "term_frequency"
    )
    out["roundtrip_united"] = sql(
        "SELECT empi, outcome, NULL AS prior365_treatment_flag, 1 AS part FROM cohort UNION ALL "
        "SELECT empi, 'NA', prior365_treatment_flag, 2 FROM cohort",
        "cohort",
    )
    out["roundtrip_embeddings"] = sql(
        "SELECT vec_id, document, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS place, "
        "round(CAST(unnest(embedding) AS DOUBLE), 4) + 0.0 AS x FROM vectors",
        "vectors",
    )
    out["roundtrip_sentences"] = sql(sentences, "notes")
    both = [_presence("unigrams", "top_unigrams", "empi"), _presence("bigrams", "top_bigrams", "empi")]
    out["roundtrip_ngrams"] = sql(
        " UNION ALL ".join(f"SELECT * FROM ({x})" for x in both), "unigrams", "top_unigrams", "bigrams", "top_bigrams"
    )
    out["roundtrip_ngram_shards"] = sql(
        f"SELECT empi || CAST({sas} AS VARCHAR) AS empi_indexdt, ngram, CAST(span AS DOUBLE) AS value, "
        "'unigram_' || CAST((place - 1) // 1000 + 1 AS VARCHAR) || '.csv' AS source "
        "FROM presence_empi_expdate JOIN (SELECT ngram, row_number() OVER (ORDER BY n DESC, ngram) AS place FROM unigram_counts) "
        f"USING (ngram) WHERE place <= {TOP_K}",
        "presence_empi_expdate",
        "unigram_counts",
    )
    view("roundtrip_topics", "topic_rows")
    out["roundtrip_topic_strings"] = sql(
        "SELECT s.empi, s.expdate, s.notedate, abs(s.days) AS diff, s.notetype, t.topic, t.weight "
        "FROM signed s JOIN topic_rows t ON s.note_id = t.note_id",
        "signed",
        "topic_rows",
    )
    out["roundtrip_topic_matrices"] = out["topic_binary"]
    out["roundtrip_clusters"] = out["cluster_sets"]
    out["roundtrip_reports"] = out["cluster_sample"]
    out["reuse_results"] = out["unigram_counts"]

    features = (
        "SELECT empi, expdate, 'ngram1' AS family, ngram AS feature, CAST(span AS DOUBLE) AS value FROM presence_empi_expdate "
        "UNION ALL SELECT empi, expdate, 'ngram2', ngram, CAST(span AS DOUBLE) FROM presence_bigram "
        "UNION ALL SELECT empi, expdate, 'code_' || source, code, CAST(n AS DOUBLE) FROM codes "
        "UNION ALL SELECT empi, expdate, family, feature, CAST(frequency AS DOUBLE) FROM term_frequency "
        "UNION ALL SELECT DISTINCT c.empi, c.expdate, 'cluster', 'Cluster_ID_' || CAST(cluster AS VARCHAR), 1.0 "
        "FROM cluster_labels l JOIN cohort c ON c.empi = l.empi"
    )
    sources = (
        "presence_empi_expdate",
        "presence_bigram",
        "codes",
        "term_frequency",
        "cluster_labels",
        "cohort",
    )
    out["covariates_long"] = sql(features, *sources)
    out["covariate_totals"] = sql(
        "SELECT count(DISTINCT (empi, expdate)) AS participants, count(DISTINCT (family, feature)) AS covariates "
        f"FROM ({features})",
        *sources,
    )
    out["covariates_sparse"] = sql(
        "SELECT c.empi, c.expdate, coalesce(string_agg(CAST(i.id AS VARCHAR), ' ' ORDER BY i.id), '') AS indices, "
        "coalesce(string_agg(CAST(CAST(i.value AS BIGINT) AS VARCHAR), ' ' ORDER BY i.id), '') AS values FROM cohort c LEFT JOIN ("
        f"SELECT f.empi, f.expdate, f.value, n.id FROM ({features}) f JOIN (SELECT family, feature, "
        f"row_number() OVER (ORDER BY family, feature) - 1 AS id FROM (SELECT DISTINCT family, feature FROM ({features}))) n "
        "ON f.family = n.family AND f.feature = n.feature) i ON c.empi = i.empi AND c.expdate = i.expdate GROUP BY c.empi, c.expdate",
        *sources,
    )
    out.update(_sentences())
    out["reuse_by_input"] = sql(
        "SELECT notetype, count(*) AS n, 'first' AS built, run FROM notes, (VALUES ('first'), ('second')) r(run) GROUP BY notetype, run "
        "UNION ALL SELECT notetype, count(*), 'third', 'third' FROM notes WHERE note_id % 3 <> 0 GROUP BY notetype",
        "notes",
    )
    out.update(_vectors())
    out.update(_topic_tables())
    out["embed_model"] = out["embed_hashed"]
    out["settings_job_sentences"] = out["embed_model_sentences"]
    out["settings_job_ngrams"] = sql(
        "SELECT *, 1 AS n FROM presence_empi_expdate UNION ALL SELECT *, 2 AS n FROM presence_bigram", "presence_empi_expdate", "presence_bigram"
    )
    return out


def _sentences() -> dict[str, str]:
    """Counts of words with and without a full stop, their log-likelihood ratio, and the cuts that remain."""
    kind = r"regexp_replace(lower({}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g')"
    ended = r"regexp_matches({}, '^(?s:.*[\p{{L}}\p{{N}}])\.$')"
    learned = f"""types AS (SELECT {kind.format('w')} AS word FROM (SELECT unnest(regexp_split_to_array(text, {WS})) AS w FROM signed) WHERE w <> ''),
stops AS (SELECT regexp_replace(word, '\\.$', '') AS word, {ended.format('word')} AS stopped FROM types),
counts AS MATERIALIZED (SELECT word, count(*) FILTER (stopped)::DOUBLE AS a, count(*) FILTER (NOT stopped)::DOUBLE AS b FROM stops WHERE word <> '' GROUP BY word),
share AS (SELECT sum(a) / sum(a + b) AS p FROM counts),
sized AS (SELECT word, a, b, p, length(word) - length(replace(word, '.', '')) AS dots FROM counts, share WHERE a > 0),
scored AS (SELECT word, -2 * (a * ln(p) + CASE WHEN b > 0 THEN b * ln(1 - p) ELSE 0.0 END - (a * ln(0.99::DOUBLE) + b * ln(1 - 0.99::DOUBLE)))
 * exp(-(length(word) - dots)::DOUBLE) * (dots + 1) * pow((length(word) - dots)::DOUBLE, -b) AS score FROM sized),
abbreviations AS MATERIALIZED (SELECT word, score FROM scored WHERE score >= 0.3)"""
    cut = f"string_split(regexp_replace(text, '([.!?])' || {WS}, '\\1' || chr(1), 'g'), chr(1))"
    last = kind.format(f"regexp_split_to_array(part, {WS})[-1]")
    split = f"""{learned},
pieces AS (SELECT note_id, unnest(generate_series(1, len({cut}))) AS piece, unnest({cut}) AS part FROM signed),
marked AS (SELECT note_id, piece, part, CASE WHEN {ended.format('last')} AND regexp_replace(last, '\\.$', '') IN (SELECT word FROM abbreviations) THEN 0 ELSE 1 END AS ends
 FROM (SELECT *, {last} AS last FROM pieces)),
placed AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY note_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM marked)"""
    return {
        "sentence_abbreviations": sql("SELECT word, CAST(floor(score * 1000 + 0.5) AS BIGINT) AS score FROM abbreviations", "signed", extra=learned),
        "sentence_split_learned": sql(
            "SELECT * FROM (SELECT note_id, CAST(sentence AS INTEGER) AS position, string_agg(part, ' ' ORDER BY piece) AS document FROM placed GROUP BY ALL) WHERE trim(document, ' ') <> ''",
            "signed",
            extra=split,
        ),
    }


INDEX_SIZE, INDEX_WINDOW, INDEX_CELLS, INDEX_COUNT = 16, 2, 4, 5
HEX = "0123456789abcdef"


def _digit(word: str, i: str, at: int) -> str:
    return f"(strpos('{HEX}', substr(md5({word} || '#' || {i}), {at}, 1)) - 1)"


def _vectors() -> dict[str, str]:
    """Random indexing: sums of fixed sparse vectors of the words within the window."""
    number = f"((({_digit('context', 'i', 1)} * 16 + {_digit('context', 'i', 2)}) * 16 + {_digit('context', 'i', 3)}) * 16 + {_digit('context', 'i', 4)})"
    extra = f"""known AS MATERIALIZED (SELECT term FROM places GROUP BY term HAVING count(*) >= {INDEX_COUNT}),
spots AS MATERIALIZED (SELECT note_id, pos, term FROM places),
near AS MATERIALIZED (SELECT a.term AS word, b.term AS context, count(*) AS n FROM spots a JOIN spots b
 ON a.note_id = b.note_id AND b.pos BETWEEN a.pos - {INDEX_WINDOW} AND a.pos + {INDEX_WINDOW} AND a.pos <> b.pos
 WHERE a.term IN (SELECT term FROM known) GROUP BY ALL),
parts AS (SELECT context, {number} % {INDEX_SIZE} AS cell, 1 - 2 * ({_digit('context', 'i', 5)} % 2) AS sign
 FROM (SELECT DISTINCT context FROM near), (SELECT unnest(range({INDEX_CELLS})) AS i)),
sums AS (SELECT word AS term, cell, sum(n * sign) AS x FROM near JOIN parts USING (context) GROUP BY ALL),
full_sums AS (SELECT k.term, c.cell, CAST(coalesce(x, 0) AS DOUBLE) AS x FROM known k CROSS JOIN (SELECT unnest(range({INDEX_SIZE})) AS cell) c
 LEFT JOIN sums s ON s.term = k.term AND s.cell = c.cell),
vecs AS MATERIALIZED (SELECT term, cell, CASE WHEN len > 0 THEN x / len ELSE 0.0 END AS v
 FROM full_sums JOIN (SELECT term, sqrt(sum(x * x)) AS len FROM full_sums GROUP BY term) USING (term))"""
    shown = "string_agg(CAST(CAST(floor(v * 1e6 + 0.5) AS BIGINT) AS VARCHAR), ' ' ORDER BY cell)"
    tokens = sql(
        f"SELECT note_id, CAST(pos AS INTEGER) AS position, term AS token, vector FROM places JOIN (SELECT term, {shown} AS vector FROM vecs GROUP BY term) USING (term)",
        "places",
        extra=extra,
    )
    documents = sql(
        f"SELECT note_id, {shown} AS vector FROM (SELECT note_id, cell, sum(n * v) / sum(n) AS v FROM "
        "(SELECT note_id, term, count(*) AS n FROM places GROUP BY ALL) JOIN vecs USING (term) GROUP BY ALL) GROUP BY note_id",
        "places",
        extra=extra,
    )
    cut = f"string_split(regexp_replace(text, '([.!?])' || {WS}, '\\1' || chr(1), 'g'), chr(1))"
    digit = f"strpos('{HEX}', substr(md5(word || '#0'), i, 1))"
    words = f"list_filter(regexp_split_to_array(document, {WS}), lambda w: w <> '')"
    sentences = sql(
        "SELECT note_id, CAST(position AS INTEGER) AS position, string_agg(CAST(CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR), ' ' ORDER BY i) AS vector FROM ("
        f"SELECT note_id, position, i, CAST((sum({digit}) * 2 - count(*) * 17) / (count(*) * 15.0) AS FLOAT) AS x FROM ("
        f"SELECT note_id, position, unnest({words}) AS word FROM (SELECT note_id, unnest(generate_series(0, len({cut}) - 1)) AS position, "
        f"unnest({cut}) AS document FROM signed)), (SELECT unnest(generate_series(1, 16)) AS i) GROUP BY ALL) GROUP BY note_id, position",
        "signed",
    )
    return {"embed_tokens": tokens, "embed_documents": documents, "embed_model_sentences": sentences}


TABLE_TOPICS, TABLE_STEPS, TABLE_BETA = 5, 4, 0.01


def _topic_tables() -> dict[str, str]:
    """Every step of the topic table as plain joins: one row for each note, term and topic."""
    k = TABLE_TOPICS
    terms = f"strpos('{HEX}', substr(md5(term || '#' || k), 1, 1))"
    parts = [
        "bag AS MATERIALIZED (SELECT note_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT note_id, unnest(tokens) AS term FROM topic_tokens) "
        "WHERE term IN (SELECT term FROM document_frequency) GROUP BY note_id, term)",
        f"ks AS (SELECT unnest(range({k})) AS k)",
        f"phi0 AS MATERIALIZED (SELECT term, k, h / sum(h) OVER (PARTITION BY k) AS w FROM (SELECT term, k, CAST({terms} AS DOUBLE) AS h FROM (SELECT DISTINCT term FROM bag), ks))",
        f"theta0 AS MATERIALIZED (SELECT note_id, k, 1.0::DOUBLE / {k} AS t FROM (SELECT DISTINCT note_id FROM bag), ks)",
    ]

    def step(name: str, phi: str, theta: str) -> None:
        parts.append(
            f"{name} AS MATERIALIZED (SELECT note_id, term, k, tf * p / sum(p) OVER (PARTITION BY note_id, term) AS s FROM "
            f"(SELECT note_id, term, tf, k, t * w AS p FROM bag JOIN {phi} USING (term) JOIN {theta} USING (note_id, k)))"
        )

    def notes(name: str, shares: str) -> None:
        parts.append(
            f"{name} AS MATERIALIZED (SELECT note_id, k, x / sum(x) OVER (PARTITION BY note_id) AS t FROM (SELECT note_id, k, sum(s) + 1.0::DOUBLE / {k} AS x FROM {shares} GROUP BY note_id, k))"
        )

    for i in range(1, TABLE_STEPS + 1):
        step(f"r{i}", f"phi{i - 1}", f"theta{i - 1}")
        parts.append(
            f"phi{i} AS MATERIALIZED (SELECT term, k, x / sum(x) OVER (PARTITION BY k) AS w FROM (SELECT term, k, sum(s) + {TABLE_BETA} AS x FROM r{i} GROUP BY term, k))"
        )
        notes(f"theta{i}", f"r{i}")
    model = ", ".join(parts)
    last = TABLE_STEPS
    parts = [model]
    for i in range(1, TABLE_STEPS + 1):
        step(f"f{i}", f"phi{last}", f"fold{i - 1}" if i > 1 else "theta0")
        notes(f"fold{i}", f"f{i}")
    folded = ", ".join(parts)
    micro = "CAST(floor({} * 1e6 + 0.5) AS BIGINT) AS micro"
    used = ("topic_tokens", "document_frequency")
    weights = "SELECT note_id, CAST(k AS INTEGER) AS topic, " + micro.format("t") + " FROM {} WHERE t >= 0.01"
    return {
        "topic_table_terms": sql(
            f"SELECT CAST(k AS INTEGER) AS topic, CAST(rank AS INTEGER) AS rank, term, {micro.format('w')} FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY k ORDER BY floor(w * 1e9 + 0.5) DESC, term) AS rank FROM phi{last}) WHERE rank <= 20",
            *used,
            extra=model,
        ),
        "topic_table_contributions": sql(weights.format(f"theta{last}"), *used, extra=model),
        "topic_table_fold_in": sql(weights.format(f"fold{TABLE_STEPS}"), *used, extra=folded),
        "topic_table_perplexity": sql(
            f"SELECT CAST(sum(tf) AS BIGINT) AS words, {micro.format('sum(tf * ln(p)) / sum(tf)')} FROM (SELECT note_id, term, any_value(tf) AS tf, sum(t * w) AS p "
            f"FROM bag JOIN phi{last} USING (term) JOIN theta{last} USING (note_id, k) GROUP BY note_id, term)",
            *used,
            extra=model,
        ),
    }
