"""The registered queries as DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

from doccluster.functions.text import STOPWORDS
from doccluster.operators.evaluation import METRICS
from doccluster.operators.kmeans import NUM_FEATURES
from doccluster.queries import (
    CENTERS,
    FEATURES,
    FREY_PREFERENCE,
    KMEANS_ROUNDS,
    NEIGHBORS,
    PREFERENCE,
    ROUNDS,
    SEED,
)

STOP_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOPWORDS))
TRIM = r"regexp_replace(lower(text), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
NORMAL = (
    rf"regexp_replace(regexp_replace({TRIM}, '[\p{{P}}\p{{S}}\p{{N}}]', ' ', 'g'),"
    r" '[ \t\n\x0B\f\r]+', ' ', 'g')"
)
RAW_TOKENS = "CASE WHEN text = ' ' THEN [] ELSE string_split(rtrim(text, ' '), ' ') END"
KEPT = f"(length(x) > 1 OR strlen(x) > 3) AND x NOT IN ({STOP_LIST})"
FILTERED_TOKENS = f"list_filter(string_split(text, ' '), lambda x: {KEPT})"


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def norm(cate: str = "lang") -> str:
    return f"norm AS (SELECT doc_id, {cate} AS cate, {NORMAL} AS text FROM documents)"


RAW = f"raw AS (SELECT doc_id, unnest({RAW_TOKENS}) AS term FROM norm)"
RAW_TF = (
    "tf AS MATERIALIZED (SELECT doc_id, term, count(*)::BIGINT AS tf FROM raw GROUP BY ALL)"
)
DOC = (
    "doc AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS len,"
    " sum(tf * tf)::BIGINT AS norm2 FROM tf GROUP BY ALL)"
)
FILT = f"filt AS (SELECT cate, doc_id, unnest({FILTERED_TOKENS}) AS term FROM norm)"
CAT_TF = (
    "ctf AS MATERIALIZED"
    " (SELECT cate, doc_id, term, count(*)::BIGINT AS tf FROM filt GROUP BY ALL)"
)
CDF = "cdf AS MATERIALIZED (SELECT cate, term, count(*)::BIGINT AS df FROM ctf GROUP BY ALL)"
SIZES = "sizes AS (SELECT cate, count(*)::BIGINT AS n_docs FROM norm GROUP BY ALL)"


def glog(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ln({x}) ELSE 0 END)"


def ratio_log(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0 WHEN {a} / {b} > 0 THEN ln({a} / {b}) ELSE 0 END)"


def smooth(x: str) -> str:
    return f"({x}) * (1 - {glog(x)})"


CELLS = """cells AS (
  SELECT c.cate, c.term, c.df, c.df / n.n AS p_ct, s.n_docs / n.n AS p_c,
         sum(c.df) OVER (PARTITION BY c.term) / n.n AS p_t
  FROM cdf c JOIN sizes s USING (cate), (SELECT count(*)::DOUBLE AS n FROM documents) n),
terms4 AS (
  SELECT cate, term, df, p_ct, p_c - p_ct AS p_cnt, p_c * p_t AS e_t, p_c * (1 - p_t) AS e_nt
  FROM cells)"""
LIG = f"abs({smooth('p_ct')} - {smooth('e_t')}) + abs({smooth('p_cnt')} - {smooth('e_nt')})"
IG = f"p_ct * {ratio_log('p_ct', 'e_t')} + p_cnt * {ratio_log('p_cnt', 'e_nt')}"
# every (category, term) with its term's scores, in one pass over the cells
SCORED = f"""scored AS MATERIALIZED (
  SELECT cate, term, df, sum({LIG}) OVER (PARTITION BY term) AS lig,
         sum({IG}) OVER (PARTITION BY term) AS ig FROM terms4)"""
SCORES = f"""scores AS MATERIALIZED (
  SELECT term, sum({LIG}) AS lig, sum({IG}) AS ig FROM terms4 GROUP BY term)"""

# --- k-means ------------------------------------------------------------------
BUCKET = f"(('0x' || substr(md5(term), 1, 8))::BIGINT % {NUM_FEATURES})::INTEGER"
HASHED = (
    f"htf AS MATERIALIZED (SELECT doc_id, {BUCKET} AS bucket, count(*)::BIGINT AS tf"
    " FROM raw GROUP BY ALL)"
)
BUCKET_IDF = (
    "idf AS (SELECT bucket, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) /"
    " (count(*) + 1)) AS idf FROM htf GROUP BY bucket)"
)
# a document without tokens has one row without a bucket
HASHED_ALL = (
    "SELECT d.doc_id, bucket, tf FROM documents d LEFT JOIN htf ON htf.doc_id = d.doc_id"
)
VECTORS = (
    "vec AS MATERIALIZED (SELECT doc_id, bucket, tf * idf AS weight FROM htf JOIN idf USING (bucket))"
)


def nearest(centers: str, out: str) -> list[str]:
    """Each document's nearest center, ties by the smaller cluster."""
    return [
        f"""{out}_cost AS MATERIALIZED (
  SELECT d.doc_id, n.cluster_id,
         round(coalesce(q.square, 0) - 2 * coalesce(t.dot, 0) + n.norm, 6) AS cost
  FROM documents d
  CROSS JOIN (SELECT cluster_id, sum(weight * weight) AS norm FROM {centers} GROUP BY 1) n
  LEFT JOIN (SELECT doc_id, sum(weight * weight) AS square FROM vec GROUP BY 1) q
    ON q.doc_id = d.doc_id
  LEFT JOIN (SELECT v.doc_id, c.cluster_id, sum(v.weight * c.weight) AS dot
             FROM vec v JOIN {centers} c ON c.bucket = v.bucket GROUP BY ALL) t
    ON t.doc_id = d.doc_id AND t.cluster_id = n.cluster_id)""",
        f"""{out} AS MATERIALIZED (SELECT doc_id, cluster_id, cost FROM {out}_cost
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cost, cluster_id) = 1)""",
    ]


def means(assigned: str, out: str) -> str:
    return f"""{out} AS MATERIALIZED (
  SELECT cluster_id, bucket, sum(weight) / any_value(n) AS weight
  FROM vec JOIN {assigned} a USING (doc_id)
  JOIN (SELECT cluster_id, count(*) AS n FROM {assigned} GROUP BY 1) s USING (cluster_id)
  GROUP BY cluster_id, bucket)"""


def kmeans_run(run: int) -> list[str]:
    """All rounds of one run, written out; ends with its assignments ``run<n>``."""
    p = f"km{run}_"
    ctes = [
        f"""{p}a0 AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY start, doc_id) - 1
  AS cluster_id FROM (SELECT doc_id, md5('{SEED}:{run}:' || doc_id) AS start FROM documents
  ORDER BY start, doc_id LIMIT {CENTERS}))""",
        means(f"{p}a0", f"{p}c0"),
    ]
    for n in range(1, KMEANS_ROUNDS + 1):
        ctes += [*nearest(f"{p}c{n - 1}", f"{p}a{n}"), means(f"{p}a{n}", f"{p}c{n}")]
    return [*ctes, *nearest(f"{p}c{KMEANS_ROUNDS}", f"run{run}")]


RAW_BASE = (norm(), RAW, RAW_TF, DOC)
CAT_BASE = (norm(), FILT, CAT_TF, CDF, SIZES)
SCORE_BASE = (*CAT_BASE, CELLS, SCORES)
SCORED_BASE = (*CAT_BASE, CELLS, SCORED)


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def icdf_base(cdf: str = "cdf") -> str:
    return (
        f"w AS (SELECT t.cate, t.doc_id, t.term, ln(1 + t.tf) * ln(s.n_docs / c.df) AS weight"
        f" FROM ctf t JOIN {cdf} c ON c.cate = t.cate AND c.term = t.term"
        f" JOIN sizes s ON s.cate = t.cate)"
    )


TOP_CDF = f"top AS (SELECT * FROM cdf ORDER BY df DESC, cate, term LIMIT {FEATURES})"
WEIGHTS = f"SELECT cate, doc_id, term, {r6('weight', 'weight')} FROM w"


def tf_times(factor: str, score: str) -> str:
    return with_ctes(
        *SCORE_BASE,
        f"w AS (SELECT cate, doc_id, term, {factor} * {score} AS weight"
        " FROM ctf JOIN scores USING (term))",
        select=WEIGHTS,
    )


FEATURE_SET = (
    f"features AS (SELECT term, lig FROM scores ORDER BY lig DESC, term LIMIT {FEATURES})"
)


def df_lig(selected: bool) -> str:
    place = "dense_rank() OVER (ORDER BY lig DESC, term)" if selected else "0"
    return (
        "dl AS (SELECT cate, term, df * lig AS weight FROM"
        f" (SELECT *, {place} AS place FROM scored) WHERE place <= {FEATURES})"
    )


RANKED = (
    "ranked AS (SELECT cate, row_number() OVER (PARTITION BY cate ORDER BY weight DESC, term)"
    " AS rank, term, weight FROM dl)"
)
LABELS = f"SELECT cate, rank, term, {r6('weight', 'weight')} FROM ranked WHERE rank <= 10"


def label_sql(cate: str, selected: bool, select: str) -> str:
    base = (norm(cate), *SCORED_BASE[1:])
    return with_ctes(*base, df_lig(selected), RANKED, select=select)


# --- similarity -------------------------------------------------------------
PAIRS = """pairs AS MATERIALIZED (
  SELECT a.doc_id AS i, b.doc_id AS k, sum(a.tf * b.tf)::BIGINT AS dot,
         sum((a.tf - b.tf) * (a.tf - b.tf))::BIGINT AS sq, sum(least(a.tf, b.tf))::BIGINT AS c
  FROM tf a JOIN tf b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL)"""
COSINE = """cosine AS MATERIALIZED (
  SELECT i, k, dot / sqrt(a.norm2::DOUBLE * b.norm2::DOUBLE) AS s
  FROM pairs JOIN doc a ON a.doc_id = i JOIN doc b ON b.doc_id = k)"""
SQUARED = "squared AS MATERIALIZED (SELECT i, k, sq::DOUBLE AS s FROM pairs)"
PAIR_BASE = (*RAW_BASE, PAIRS)
EDGES = f"SELECT i, k, {r6('s', 's')}"


def both_ways(source: str, name: str = "both_ways") -> str:
    return f"{name} AS (SELECT i, k, s FROM {source} UNION ALL SELECT k, i, s FROM {source})"


def top_n(source: str, n: int, name: str = "best") -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT i, k, s FROM (SELECT *, row_number() OVER"
        f" (PARTITION BY i ORDER BY s DESC, k) AS rn FROM {source}) WHERE rn <= {n})"
    )


def frey_matrix(diagonal: str) -> str:
    """Every ordered pair, spelled out."""
    return f"""vocabulary AS (SELECT log10(count(DISTINCT term)) AS lv FROM tf),
common AS (SELECT i, k, c FROM pairs UNION ALL SELECT k, i, c FROM pairs),
matrix AS MATERIALIZED (
  SELECT a.doc_id AS i, b.doc_id AS k, c IS NOT NULL OR a.doc_id = b.doc_id AS own_row,
    CASE WHEN a.doc_id = b.doc_id THEN {diagonal}
         WHEN c IS NULL THEN -lv * a.len
         ELSE -c * log10(b.len) - (a.len - c) * lv END AS s
  FROM doc a CROSS JOIN doc b CROSS JOIN vocabulary
  LEFT JOIN common ON common.i = a.doc_id AND common.k = b.doc_id)"""


FREY_RANKED = (
    "(SELECT m.i, m.k, CASE WHEN m.i = m.k THEN -lv * len - ("
    f"{FREY_PREFERENCE}) ELSE s END AS s FROM matrix m JOIN doc ON doc_id = m.i, vocabulary)"
)


def frey_messages(own: str) -> str:
    """The pruned edges to others, and one edge of every document to itself."""
    return (
        "messages AS MATERIALIZED (SELECT i, k, s FROM best WHERE i <> k"
        f" UNION ALL SELECT doc_id, doc_id, {own} FROM doc, vocabulary)"
    )


GIVEN_DIAGONAL = f"-lv * a.len - {PREFERENCE}"
FREY_ROWS = (
    f"SELECT i, k, {r6('s', 's')} FROM matrix WHERE own_row UNION ALL "
    f"SELECT doc_id, NULL, {r6('-lv * len', 's')} FROM doc, vocabulary"
)


# --- affinity propagation ---------------------------------------------------
def preferences(source: str, value: str, name: str = "graph") -> str:
    nodes = f"(SELECT i FROM {source} UNION SELECT k FROM {source})"
    return (
        f"{name} AS MATERIALIZED (SELECT i, k, s FROM {source} WHERE i <> k"
        f" UNION ALL SELECT i, i, {value} FROM {nodes})"
    )


def median(source: str) -> str:
    return f"(SELECT quantile_cont(s, 0.5) FROM {source} WHERE i <> k)"


def directed(source: str, name: str, symmetric: bool) -> str:
    rows = f"SELECT i, k, s FROM {source}"
    if symmetric:
        rows += f" UNION ALL SELECT k, i, s FROM {source} WHERE i <> k"
    return f"{name} AS MATERIALIZED (SELECT i, k, max(s) AS s FROM ({rows}) GROUP BY i, k)"


def propagation(source: str, rounds: int, p: str = "") -> list[str]:
    """Rounds of message passing over ``source`` and the assignment at the end."""
    ctes = [
        f"{p}e0 AS MATERIALIZED"
        f" (SELECT i, k, s, 0.0::DOUBLE AS r, 0.0::DOUBLE AS a FROM {source})"
    ]
    for n in range(1, rounds + 1):
        before = f"{p}e{n - 1}"
        ctes += [
            f"""{p}t{n} AS MATERIALIZED (
  SELECT i, max(CASE WHEN rn = 1 THEN k END) AS bk, max(CASE WHEN rn = 1 THEN v END) AS v1,
         max(CASE WHEN rn = 2 THEN v END) AS v2
  FROM (SELECT i, k, a + s AS v,
               row_number() OVER (PARTITION BY i ORDER BY a + s DESC, k) AS rn FROM {before})
  WHERE rn <= 2 GROUP BY i)""",
            f"""{p}r{n} AS MATERIALIZED (
  SELECT i, k, s, 0.5 * r + 0.5 * (s - CASE WHEN k = bk
         THEN coalesce(v2, '-infinity'::DOUBLE) ELSE v1 END) AS r, a
  FROM {before} JOIN {p}t{n} USING (i))""",
            f"""{p}p{n} AS MATERIALIZED (
  SELECT k, sum(CASE WHEN i = k THEN 0 ELSE greatest(r, 0) END) AS sup,
         max(CASE WHEN i = k THEN r END) AS rk FROM {p}r{n} GROUP BY k)""",
            f"""{p}e{n} AS MATERIALIZED (
  SELECT i, k, s, r, 0.5 * a + 0.5 * CASE WHEN i = k THEN sup
         ELSE least(0, rk + sup - greatest(r, 0)) END AS a
  FROM {p}r{n} JOIN {p}p{n} USING (k))""",
        ]
    last = f"{p}e{rounds}"
    return ctes + [
        f"""{p}choice AS MATERIALIZED (
  SELECT i, k FROM (SELECT i, k, row_number() OVER
    (PARTITION BY i ORDER BY round(a + r, 9) DESC, k) AS rn FROM {last}) WHERE rn = 1)""",
        f"""{p}nearest AS (
  SELECT i, k FROM (SELECT i, k, row_number() OVER
    (PARTITION BY i ORDER BY round(s, 9) DESC, k) AS rn FROM {last}
    WHERE i <> k AND k IN (SELECT k FROM {p}choice WHERE i = k)) WHERE rn = 1)""",
        f"""{p}assigned AS MATERIALIZED (
  SELECT c.i AS doc_id, CASE WHEN c.i = c.k THEN c.i ELSE coalesce(n.k, c.i) END AS exemplar
  FROM {p}choice c LEFT JOIN {p}nearest n ON n.i = c.i)""",
        f"""{p}clusters AS MATERIALIZED (
  SELECT doc_id, exemplar, dense_rank() OVER (ORDER BY exemplar) - 1 AS cluster_id
  FROM {p}assigned)""",
    ]


def pruned_clusters(source: tuple[str, ...], name: str, value: str) -> tuple[str, ...]:
    return (
        *source,
        preferences(name, value),
        directed("graph", "messages", symmetric=False),
        *propagation("messages", ROUNDS),
    )


PRUNED_COSINE = (*PAIR_BASE, COSINE, both_ways("cosine"), top_n("both_ways", NEIGHBORS))
PRUNED_SQUARED = (*PAIR_BASE, SQUARED, both_ways("squared"), top_n("both_ways", NEIGHBORS))
PRUNED_FREY = (*PAIR_BASE, frey_matrix(GIVEN_DIAGONAL), top_n("matrix", NEIGHBORS))
COSINE_CLUSTERS = pruned_clusters(PRUNED_COSINE, "best", median("best"))
ASSIGNED = "SELECT doc_id, exemplar, cluster_id FROM clusters"


# --- evaluation -------------------------------------------------------------
def metric_ctes(system: str, gold: str, p: str = "") -> list[str]:
    """Metrics by counting document pairs' group sizes; ``system`` is (doc_id, cluster_id)."""
    return [
        f"{p}k AS (SELECT cluster_id, count(*)::DOUBLE AS nk FROM {system} GROUP BY 1)",
        f"{p}g AS (SELECT label, count(*)::DOUBLE AS nj FROM {gold} GROUP BY 1)",
        f"{p}cell AS MATERIALIZED (SELECT cluster_id, label, count(*)::DOUBLE AS n"
        f" FROM {system} JOIN {gold} USING (doc_id) GROUP BY 1, 2)",
        f"{p}nn AS (SELECT sum(nk) AS n FROM {p}k)",
        f"""{p}pair AS (SELECT tp, same - tp AS fp, fn, n * (n - 1) / 2 - same - fn AS tn FROM
  (SELECT sum(n * (n - 1) / 2) AS tp FROM {p}cell),
  (SELECT sum(nk * (nk - 1) / 2) AS same FROM {p}k),
  (SELECT coalesce(sum(a.n * b.n), 0) AS fn FROM {p}cell a JOIN {p}cell b
     ON a.label = b.label AND a.cluster_id < b.cluster_id), {p}nn)""",
        f"""{p}metrics AS (SELECT
  (SELECT sum(m) FROM (SELECT max(n) AS m FROM {p}cell GROUP BY cluster_id)) / nn.n AS purity,
  (tp + tn) / (tp + fp + fn + tn) AS rand_index,
  tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
  2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1,
  2 * (SELECT sum(c.n / nn.n * ln(nn.n * c.n / k.nk / g.nj))
       FROM {p}cell c JOIN {p}k k USING (cluster_id) JOIN {p}g g USING (label))
    / abs((SELECT -sum(nk / nn.n * ln(nk / nn.n)) FROM {p}k)
        + (SELECT -sum(nj / nn.n * ln(nj / nn.n)) FROM {p}g)) AS nmi
  FROM {p}pair, {p}nn nn)""",
    ]


SYSTEM = "system AS (SELECT doc_id, source AS cluster_id FROM documents)"
GOLD = "gold AS (SELECT doc_id, lang AS label FROM documents)"
QUALITY = "gold AS (SELECT doc_id, quality::VARCHAR AS label FROM labels)"
NUMBERED = (
    "numbered AS (SELECT doc_id, dense_rank() OVER (ORDER BY first) AS cluster_id FROM"
    " (SELECT doc_id, min(doc_id) OVER (PARTITION BY source) AS first FROM documents))"
)


def metric_sql(*names: str, gold: str = GOLD) -> str:
    columns = ", ".join(r6(m, m) for m in names)
    return with_ctes(
        SYSTEM, gold, *metric_ctes("system", "gold"), select=f"SELECT {columns} FROM metrics"
    )


def size_text(system: str) -> str:
    return (
        "(SELECT string_agg(size::VARCHAR, '|' ORDER BY cluster_id) FROM"
        f" (SELECT cluster_id, count(*) AS size FROM {system} GROUP BY 1))"
    )


def assignment_text(system: str) -> str:
    return (
        "(SELECT string_agg(position || ' ' || cluster_id, '|' ORDER BY position) FROM (SELECT"
        f" row_number() OVER (ORDER BY doc_id) - 1 AS position, cluster_id FROM {system}))"
    )


# Names and sizes of the sweep's settings, and what parts the ids of two settings.
SWEEP = (
    ("all", None), ("10", 10), ("50", 50), ("100", 100), ("200", 200),
    ("300", 300), ("500", 500), ("1k", 1000), ("1.5k", 1500),
)
APART = 10**15


def sweep_sql(part: str) -> str:
    """All settings, as one graph whose parts have ids of their own; 20 rounds."""
    ctes = [*PAIR_BASE, COSINE, both_ways("cosine"), GOLD]
    graphs = []
    for n, (_, limit) in enumerate(SWEEP):
        source = "cosine"
        if limit is not None:
            source = f"best{n}"
            ctes.append(top_n("both_ways", limit, source))
        ctes.append(preferences(source, median(source), f"graph{n}"))
        graphs.append(f"SELECT i + {n * APART} AS i, k + {n * APART} AS k, s FROM graph{n}")
    ctes.append(f"graphs AS ({' UNION ALL '.join(graphs)})")
    ctes.append(directed("graphs", "messages", symmetric=True))
    ctes += propagation("messages", 20)
    selects = []
    for n, (tag, _) in enumerate(SWEEP):
        p = f"s{n}_"
        ctes.append(
            f"{p}system AS MATERIALIZED (SELECT doc_id,"
            " dense_rank() OVER (ORDER BY exemplar) - 1 AS cluster_id FROM (SELECT d.doc_id,"
            f" coalesce(exemplar - {n * APART}, d.doc_id) AS exemplar FROM documents d"
            f" LEFT JOIN clusters c ON c.doc_id = d.doc_id + {n * APART}))"
        )
        head = (
            f"SELECT 'all' AS category, 0 AS first, 1 AS last, '{tag}' AS setting,"
            f" 'DF' AS df, 'TF' AS tf,"
            f" (SELECT count(DISTINCT cluster_id) FROM {p}system) AS n_clusters,"
            f" {size_text(p + 'system')} AS sizes"
        )
        if part == "system":
            assignments = assignment_text(p + "system")
            selects.append(f"{head}, {assignments} AS assignments")
        else:
            ctes += metric_ctes(f"{p}system", "gold", p)
            columns = ", ".join(r6(m, m) for m in METRICS)
            selects.append(f"{head}, {columns} FROM {p}metrics")
    return with_ctes(*ctes, select=" UNION ALL ".join(selects))


ONE_LINE = r"regexp_replace(text, '[\r\n]+', ' ', 'g')"
TERM_SCORES = with_ctes(
    *SCORE_BASE, select=f"SELECT term, {r6('lig', 'lig')}, {r6('ig', 'ig')} FROM scores"
)
CATEGORY_SCORES = with_ctes(
    *SCORED_BASE, select=f"SELECT cate, term, {r6('lig', 'lig')}, {r6('ig', 'ig')} FROM scored"
)


def positions(tokens: str) -> str:
    return with_ctes(
        norm(),
        f"lists AS (SELECT doc_id, {tokens} AS x FROM norm)",
        select="SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS term FROM lists",
    )


def all_oracles() -> dict[str, str]:
    found = single_oracles()
    # whole jobs, read back
    return found | {
        "write_cluster_labels": found["cluster_labels_nested"],
        "write_ap_clusters": found["ap_clusters"],
        "write_kmeans_assignments": found["kmeans_assignments"],
    }


def single_oracles() -> dict[str, str]:
    return {
        "normalize_text": with_ctes(norm(), select="SELECT doc_id, text FROM norm"),
        "tokenize_raw": positions(RAW_TOKENS),
        "tokenize_filtered": positions(FILTERED_TOKENS),
        "doc_length": with_ctes(
            norm(), select=f"SELECT doc_id, len({RAW_TOKENS}) AS len FROM norm"
        ),
        "term_frequency": with_ctes(norm(), FILT, CAT_TF, select="SELECT * FROM ctf"),
        "term_frequency_raw": with_ctes(norm(), RAW, RAW_TF, select="SELECT * FROM tf"),
        "distinct_doc_terms": with_ctes(norm(), FILT, select="SELECT DISTINCT * FROM filt"),
        "category_size": with_ctes(norm(), SIZES, select="SELECT * FROM sizes"),
        "corpus_size": "SELECT count(*) AS n_docs FROM documents",
        "category_term_df": with_ctes(*CAT_BASE, select="SELECT * FROM cdf"),
        "term_df": with_ctes(
            *CAT_BASE, select="SELECT term, sum(df)::BIGINT AS df FROM cdf GROUP BY term"
        ),
        "vocabulary_size": with_ctes(
            norm(), RAW, select="SELECT count(DISTINCT term) AS vocabulary FROM raw"
        ),
        "doc_norm": with_ctes(
            *RAW_BASE,
            select=f"SELECT doc_id, {r6('sqrt(coalesce(norm2, 0))', 'norm')}"
            " FROM documents LEFT JOIN doc USING (doc_id)",
        ),
        "posting_lists": with_ctes(
            norm(), FILT, CAT_TF,
            select="SELECT term, doc_id >> 16 AS chunk,"
            " string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings"
            " FROM ctf GROUP BY ALL",
        ),
        "lig": with_ctes(*SCORE_BASE, select=f"SELECT term, {r6('lig', 'lig')} FROM scores"),
        "ig": with_ctes(*SCORE_BASE, select=f"SELECT term, {r6('ig', 'ig')} FROM scores"),
        "term_scores": TERM_SCORES,
        "category_term_scores": CATEGORY_SCORES,
        "tf_icdf": with_ctes(*CAT_BASE, icdf_base(), select=WEIGHTS),
        "tf_icdf_top_n": with_ctes(*CAT_BASE, TOP_CDF, icdf_base("top"), select=WEIGHTS),
        "tf_lig": tf_times("tf", "lig"),
        "log_tf_lig": tf_times("ln(1 + tf)", "lig"),
        "log_tf_ig": tf_times("ln(1 + tf)", "ig"),
        "doc_weight_vectors": with_ctes(
            *CAT_BASE, icdf_base(),
            select="SELECT cate, doc_id, count(*) AS n_terms, string_agg(term || ':' ||"
            " round(weight * 1000000)::BIGINT, ' ' ORDER BY term) AS terms FROM w GROUP BY ALL",
        ),
        "select_features_by_lig": with_ctes(
            *SCORE_BASE, FEATURE_SET, select=f"SELECT term, {r6('lig', 'lig')} FROM features"
        ),
        "df_lig": with_ctes(
            *SCORED_BASE, df_lig(selected=False),
            select=f"SELECT cate, term, {r6('weight', 'weight')} FROM dl",
        ),
        "df_lig_selected": with_ctes(
            *SCORED_BASE, df_lig(selected=True),
            select=f"SELECT cate, term, {r6('weight', 'weight')} FROM dl",
        ),
        "cluster_labels": label_sql("lang", False, LABELS),
        "cluster_labels_by_source": label_sql("source", True, LABELS),
        "cluster_labels_nested": label_sql(
            "lang", False,
            "SELECT cate, string_agg(term, ' ' ORDER BY rank) AS labels"
            " FROM ranked WHERE rank <= 10 GROUP BY cate",
        ),
        "cosine_similarity": with_ctes(*PAIR_BASE, COSINE, select=f"{EDGES} FROM cosine"),
        "euclidean_similarity": with_ctes(
            *PAIR_BASE, SQUARED, select=f"SELECT i, k, {r6('sqrt(s)', 's')} FROM squared"
        ),
        "frey_similarity": with_ctes(*PAIR_BASE, frey_matrix(GIVEN_DIAGONAL), select=FREY_ROWS),
        "frey_similarity_auto": with_ctes(*PAIR_BASE, frey_matrix("0.0"), select=FREY_ROWS),
        "cosine_top_n": with_ctes(*PRUNED_COSINE, select=f"{EDGES} FROM best"),
        "euclidean_top_n": with_ctes(*PRUNED_SQUARED, select=f"{EDGES} FROM best"),
        "frey_top_n": with_ctes(*PRUNED_FREY, select=f"{EDGES} FROM best"),
        "symmetrize_edges": with_ctes(
            *PAIR_BASE, COSINE, both_ways("cosine"), select=f"{EDGES} FROM both_ways"
        ),
        "embed_preferences": with_ctes(
            *PAIR_BASE, COSINE, preferences("cosine", "-1.0"), select=f"{EDGES} FROM graph"
        ),
        "auto_preferences": with_ctes(
            *PAIR_BASE, COSINE, preferences("cosine", median("cosine")),
            select=f"{EDGES} FROM graph",
        ),
        "affinity_propagation": with_ctes(
            *PAIR_BASE, COSINE, preferences("cosine", median("cosine")),
            directed("graph", "messages", symmetric=True), *propagation("messages", ROUNDS),
            select=ASSIGNED,
        ),
        "cluster_documents_ap_cosine": with_ctes(*COSINE_CLUSTERS, select=ASSIGNED),
        "cluster_documents_ap_euclidean": with_ctes(
            *pruned_clusters(PRUNED_SQUARED, "best", median("best")), select=ASSIGNED
        ),
        "cluster_documents_ap_frey": with_ctes(
            *PAIR_BASE, frey_matrix("NULL"), top_n(FREY_RANKED, NEIGHBORS),
            frey_messages(f"-lv * len - ({FREY_PREFERENCE})"),
            *propagation("messages", ROUNDS), select=ASSIGNED,
        ),
        "cluster_documents_ap_frey_auto": with_ctes(
            *PAIR_BASE, frey_matrix("0.0"), top_n("matrix", NEIGHBORS),
            frey_messages(median("best")), *propagation("messages", ROUNDS), select=ASSIGNED,
        ),
        "ap_clusters": with_ctes(
            *COSINE_CLUSTERS,
            select="SELECT cluster_id, exemplar, doc_id >> 16 AS chunk,"
            " string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS members"
            " FROM clusters GROUP BY ALL",
        ),
        "ap_assignments": with_ctes(
            *COSINE_CLUSTERS, select="SELECT doc_id, cluster_id FROM clusters"
        ),
        "ap_topn_sweep_system": sweep_sql("system"),
        "ap_topn_sweep_result": sweep_sql("result"),
        "hashed_tf": with_ctes(norm(), RAW, HASHED, select=HASHED_ALL),
        "idf": with_ctes(
            norm(), RAW, HASHED, BUCKET_IDF, select=f"SELECT bucket, df, {r6('idf', 'idf')} FROM idf"
        ),
        "tfidf_vectors": with_ctes(
            norm(), RAW, HASHED, BUCKET_IDF, VECTORS,
            select=f"SELECT d.doc_id, bucket, {r6('weight', 'weight')}"
            " FROM documents d LEFT JOIN vec ON vec.doc_id = d.doc_id",
        ),
        "kmeans": with_ctes(
            norm(), RAW, HASHED, BUCKET_IDF, VECTORS, *kmeans_run(0), *kmeans_run(1),
            "cost AS (SELECT (SELECT sum(cost) FROM run0) AS one, (SELECT sum(cost) FROM run1) AS two)",
            "better AS (SELECT * FROM run0 WHERE (SELECT one <= two FROM cost)"
            " UNION ALL SELECT * FROM run1 WHERE (SELECT one > two FROM cost))",
            select="SELECT cluster_id, count(*) AS n_docs, (SELECT round(avg(cost), 4) FROM better)"
            " AS mean_cost FROM better GROUP BY cluster_id",
        ),
        "kmeans_assignments": with_ctes(
            norm(), RAW, HASHED, BUCKET_IDF, VECTORS, *kmeans_run(0),
            select="SELECT doc_id, cluster_id FROM run0",
        ),
        "contingency_table": "SELECT source AS cluster_id, lang AS label, count(*) AS n"
        " FROM documents GROUP BY ALL",
        "relabel_clusters": with_ctes(NUMBERED, select="SELECT * FROM numbered"),
        "purity": metric_sql("purity"),
        "pair_counts": with_ctes(
            SYSTEM, GOLD, *metric_ctes("system", "gold"),
            select="SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn,"
            " tn::BIGINT AS tn FROM pair",
        ),
        "rand_index": metric_sql("rand_index"),
        "pair_precision": metric_sql("precision"),
        "pair_recall": metric_sql("recall"),
        "pair_f1": metric_sql("f1"),
        "nmi": metric_sql("nmi"),
        "evaluate_clusters": metric_sql(*METRICS),
        "evaluate_clusters_quality": metric_sql(*METRICS, gold=QUALITY),
        "cluster_sizes": with_ctes(
            NUMBERED, select="SELECT cluster_id, count(*) AS size FROM numbered GROUP BY 1"
        ),
        "size_list": with_ctes(
            NUMBERED, select=f"SELECT 0::BIGINT AS chunk, {size_text('numbered')} AS sizes"
        ),
        "assignment_string": with_ctes(
            NUMBERED,
            select=f"SELECT 0::BIGINT AS chunk, {assignment_text('numbered')} AS assignments",
        ),
        "docs_from_table": "SELECT lang AS cate, doc_id, text FROM documents",
        "read_docs": f"SELECT doc_id, {ONE_LINE} AS text FROM documents",
        "read_categorized_docs": f"SELECT lang AS cate, doc_id, {ONE_LINE} AS text FROM documents",
        "malformed_lines": "SELECT count(*) AS n_lines FROM (SELECT string_split(x, ' ') AS p"
        f" FROM (SELECT {ONE_LINE} AS x FROM documents))"
        r" WHERE len(p) < 2 OR NOT regexp_full_match(p[1], '[+-]?[0-9]{1,18}')",
        "read_gold": "SELECT doc_id, lang AS label FROM documents",
        "read_tags": "SELECT DISTINCT lang AS label FROM documents",
        "write_overwrite": TERM_SCORES,
        "write_by_category": CATEGORY_SCORES,
        "append_report": "SELECT lang AS cate, count(*) AS n_docs FROM documents GROUP BY 1"
        " UNION ALL SELECT source, count(*) FROM documents GROUP BY 1",
        "write_term_scores_all": TERM_SCORES,
        "write_term_scores_tflig": tf_times("ln(1 + tf)", "lig"),
        "write_term_scores_tfig": tf_times("ln(1 + tf)", "ig"),
        "write_tf_lig": tf_times("tf", "lig"),
        "write_tf_icdf": with_ctes(*CAT_BASE, TOP_CDF, icdf_base("top"), select=WEIGHTS),
    }
