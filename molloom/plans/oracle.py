"""DuckDB SQL of the registered queries. Those without SQL: kmeans_clusters, chemical_space, neighbour_graph, lsh_neighbours
and partner_sample's choice (its counts are given); tests hold them against brute force, recall and known clusters."""

from molloom.operators.permutation import PRIME, keys

PAIRS = """
f AS (SELECT vec_id, label, list_filter(list_transform(range(len(embedding)), lambda i: CASE WHEN embedding[i+1] > 0 THEN i ELSE -1 END), lambda x: x >= 0) fp FROM embeddings),
s AS (SELECT q.vec_id q, f.vec_id, f.label, len(list_intersect(q.fp, f.fp)) c, len(q.fp) a, len(f.fp) n FROM f, f q WHERE q.vec_id % 100 = 0),
p AS (SELECT *, c / (a + n - c) t FROM s)
"""
BLOCKS = """
b AS (SELECT DISTINCT 'BB1' AS cycle, p_brand AS bb_id FROM part UNION ALL SELECT DISTINCT 'BB2', p_type FROM part UNION ALL SELECT DISTINCT 'BB3', p_size::VARCHAR FROM part)
"""
TOKENS = """
t AS (SELECT doc_id, list_filter(string_split(lower(coalesce(text, '')), ' '), lambda x: x <> '') w FROM documents),
u AS (SELECT doc_id, x, count(*) m FROM (SELECT doc_id, unnest(w) x FROM t) GROUP BY ALL),
k AS (SELECT t.doc_id, coalesce(g, '') g FROM t LEFT JOIN (SELECT doc_id, string_agg(x || '#' || m, ' ' ORDER BY x) g FROM u GROUP BY doc_id) USING (doc_id)),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY g) class_id FROM k),
r AS (SELECT doc_id, x, m FROM u WHERE doc_id IN (SELECT class_id FROM c)),
z AS (SELECT doc_id, sum(m) z FROM r GROUP BY doc_id),
o AS (SELECT a.doc_id i, b.doc_id j, sum(least(a.m, b.m)) s FROM r a JOIN r b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM o JOIN z a ON a.doc_id = i JOIN z b ON b.doc_id = j WHERE s / (a.z + b.z - s) >= 0.8),
e AS (SELECT i d FROM l UNION ALL SELECT j FROM l)
"""
SPARSE = """
v AS (SELECT vec_id, list_sort(list_transform(list_slice(list_sort(list_transform(range(len(embedding)), lambda i: struct_pack(v := -abs(embedding[i+1]), i := i))), 1, 8), lambda x: x.i)) fp FROM embeddings),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id DESC) i, vec_id, fp FROM v)
"""


def feistel(rows: str) -> str:
    """The keyed permutation of rows (id, hi, lo, high, low, n), one nested SELECT a step."""
    p = PRIME
    for j, (a, b, c, d) in enumerate(keys(0)):
        x, y, n = ("hi", "lo", "low") if j % 2 else ("lo", "hi", "high")
        rows = f"SELECT *, (({x} % {p}) * {a} % {p} + ({x} // {p}) % {p} * {b} + {c}) % {p} AS s FROM ({rows})"
        rows = f"SELECT *, ((s * s % {p}) * {d} + s + {c}) % {p} AS t FROM ({rows})"
        rows = f"SELECT *, (((t * t % {p}) * {b} + t + {c}) % {p}) * {p} + ((t * t % {p}) * {a} + t + {c}) % {p} AS f FROM ({rows})"
        new = f"({y} + f % {n}) % {n} AS {y}"
        rows = f"SELECT id, {'hi, ' + new if j % 2 else new + ', lo'}, high, low, n FROM ({rows})"
    return rows




def clusters(rounds: int) -> str:
    """Lloyd's iterations one after the other: c<j> has the centres, a<j> each vector's nearest."""
    out = """x AS (SELECT vec_id, label, unnest(range(len(embedding))) i, embedding FROM embeddings), y AS (SELECT vec_id, label, i, embedding[i+1]::DOUBLE e FROM x),
c0 AS (SELECT label, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 k, i, e FROM y QUALIFY k < 2 + label % 3)"""
    for j in range(rounds + 1):
        out += f""",
d{j} AS (SELECT y.label, vec_id, k, sum((y.e - c.e) * (y.e - c.e)) d FROM y JOIN c{j} c USING (label, i) GROUP BY ALL),
a{j} AS (SELECT label, vec_id, arg_min(k, (d, k)) k, min(d) d FROM d{j} GROUP BY ALL),
c{j + 1} AS (SELECT label, k, i, avg(e) e FROM y JOIN a{j} USING (label, vec_id) GROUP BY ALL)"""
    return out


FAIL = "CASE WHEN p_retailprice > 990 THEN 'MW' WHEN p_retailprice < 910 THEN 'MW' WHEN p_size < 3 THEN 'HBD' WHEN p_size > 40 THEN 'HBD' END"
SCHEME = """
s1 AS (SELECT *, CASE WHEN p_size > 40 THEN p_brand || '+a' WHEN p_size > 20 THEN 'b(' || p_brand || ')' WHEN p_size > 3 THEN p_brand END x1 FROM part),
s2 AS (SELECT *, CASE WHEN x1 IS NULL THEN NULL WHEN x1 LIKE 'b(%' THEN x1 WHEN p_retailprice > 955 THEN x1 || '=c' ELSE x1 || '-d' END x2, coalesce(x1 LIKE 'b(%', false) done FROM s1),
s3 AS (SELECT *, CASE WHEN x2 IS NULL THEN NULL WHEN done THEN x2 WHEN x2 LIKE '%c' THEN upper(x2) WHEN p_size <> 10 THEN x2 || '!' END x3 FROM s2)
"""

SQL = {
    "top_k_tanimoto": f"WITH {PAIRS} SELECT q, vec_id, score, rank FROM (SELECT q, vec_id, round(t, 6) score, row_number() OVER (PARTITION BY q ORDER BY round(t, 6) DESC, vec_id) rank FROM p) WHERE rank <= 3",
    "tanimoto_pairs": f"WITH {PAIRS} SELECT q, vec_id, round(t, 2) score FROM p",
    "similarity_matrix": f"WITH {PAIRS} SELECT vec_id, string_agg(coalesce(round(100 * t)::INT::VARCHAR, '-'), ',' ORDER BY q) scores FROM p GROUP BY vec_id",
    "tversky_probe_report": f"WITH {PAIRS}, h AS (SELECT *, round(c / n, 2) v FROM p WHERE round(c / n, 2) > 0.6) SELECT vec_id, count(*) n_probes, string_agg(q::VARCHAR, ';' ORDER BY q) probes, arg_max(q, (v, -q)) best_probe, max(v) best_score FROM h GROUP BY vec_id",
    "closest_list": f"WITH {PAIRS} SELECT label, round(avg(m), 6) mean_best, count(*) n_probes FROM (SELECT label, q, max(t) m FROM p GROUP BY ALL) GROUP BY label",
    "query_neighbour_counts": f"WITH {PAIRS} SELECT q, count(*) FILTER (t > 0.5) n_similar, round(avg(t), 6) mean_score FROM p GROUP BY q",
    "knn_graph": f"WITH {PAIRS} SELECT q, vec_id, score, n FROM (SELECT q, vec_id, round(t, 6) score, row_number() OVER (PARTITION BY q ORDER BY round(t, 6) DESC, vec_id) n FROM p WHERE q <> vec_id) WHERE n <= 25",
    "count_tanimoto_neighbours": f"WITH {TOKENS} SELECT doc_id, class_id, (SELECT count(*) FROM e WHERE d = class_id) n_links FROM c",
    "neighbours_at_the_cutoff": """WITH s AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 47 UNION ALL SELECT DISTINCT -1, p_brand FROM part),
k AS (SELECT l_suppkey, list_sort(list(p_brand)) b FROM s GROUP BY l_suppkey), c AS (SELECT *, min(l_suppkey) OVER (PARTITION BY b) class_id FROM k), r AS (SELECT * FROM c WHERE l_suppkey = class_id),
l AS (SELECT x.class_id i, count(*) n FROM r x JOIN r y ON x.class_id <> y.class_id AND 100 * len(list_intersect(x.b, y.b)) >= 56 * (len(x.b) + len(y.b) - len(list_intersect(x.b, y.b))) GROUP BY 1)
SELECT l_suppkey, class_id, coalesce(n, 0) n_links FROM c LEFT JOIN l ON i = class_id""",
    "sphere_exclusion": f"""WITH RECURSIVE {SPARSE},
g(i, ch, ok) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL
 SELECT n.i, CASE WHEN n.ok THEN list_append(n.ch, n.i) ELSE n.ch END, n.ok FROM (SELECT o.i, g.ch,
  NOT EXISTS (SELECT 1 FROM o x WHERE list_contains(g.ch, x.i) AND len(list_intersect(x.fp, o.fp)) / (len(x.fp) + len(o.fp) - len(list_intersect(x.fp, o.fp))) >= 0.45) ok FROM g JOIN o ON o.i = g.i + 1) n)
SELECT vec_id, CASE WHEN ok THEN 'OK' ELSE 'sim' END reason FROM g JOIN o USING (i)""",
    "diverse_walk": f"""WITH RECURSIVE {SPARSE},
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id DESC) i, vec_id, fp, label bb FROM (SELECT o.vec_id, o.fp, label, row_number() OVER (PARTITION BY o.fp ORDER BY o.vec_id DESC) k FROM o JOIN embeddings USING (vec_id)) WHERE k = 1),
t AS (SELECT x.i xi, c.i ci, len(list_intersect(x.fp, c.fp)) n FROM p x JOIN p c ON c.i < x.i),
pr AS MATERIALIZED (SELECT xi, ci, n >= 0.45 * (16 - n) hard FROM t WHERE n >= 0.25 * (16 - n)),
g(i, ch, cur, reason, grp) AS (SELECT 0::BIGINT, []::STRUCT(i BIGINT, g INT, bb INT)[], 0, ''::VARCHAR, -1 UNION ALL
 SELECT n.i, CASE WHEN n.reason = 'OK' THEN list_append(n.ch, struct_pack(i := n.i, g := n.grp, bb := n.bb)) ELSE n.ch END, n.cur + CASE WHEN n.reason = 'OK' AND n.og = -1 THEN 1 ELSE 0 END, n.reason, n.grp
 FROM (SELECT p.i, p.bb::INT bb, g.ch, g.cur, v.og, CASE WHEN v.used >= 30 THEN 'bbusage' WHEN v.rej THEN 'sim' ELSE 'OK' END reason,
   CASE WHEN v.used >= 30 THEN -1 WHEN NOT v.rej AND v.og = -1 THEN g.cur ELSE v.og END grp
  FROM g JOIN p ON p.i = g.i + 1, LATERAL (SELECT len(list_filter(g.ch, lambda c: c.bb = p.bb)) used, coalesce(bool_or(hard), false) OR count(*) >= 2 rej, coalesce(max_by(sg, ci), -1) og
   FROM (SELECT pr.ci, pr.hard, s.g sg FROM (SELECT unnest(g.ch) s) u JOIN pr ON pr.xi = p.i AND pr.ci = u.s.i)) v) n)
SELECT vec_id, reason, grp::BIGINT "group" FROM g JOIN p USING (i)""",
    "usage_cap": "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2 THEN 'OK' ELSE 'bbusage' END reason FROM orders",
    "scaffold_groups": "SELECT p_type, p_partkey, count(*) OVER t n_rows, min(p_partkey) OVER t first_row FROM part WINDOW t AS (PARTITION BY p_type)",
    "choose_compounds": """WITH m AS (SELECT p_brand, p_type main_type FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) r FROM part GROUP BY p_brand, p_type) WHERE r = 1)
SELECT p_brand, p_partkey, p_type, p_size FROM (SELECT part.*, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size = 7 AND p_type = main_type) DESC, (p_size = 7) DESC, (p_type = main_type) DESC, p_partkey) r FROM part JOIN m USING (p_brand)) WHERE r = 1""",
    "cluster_extremes": "SELECT l_returnflag, min(l_extendedprice) least, max(l_extendedprice) most FROM lineitem GROUP BY l_returnflag",
    "cluster_medoids": """WITH x AS (SELECT vec_id, label, unnest(range(len(embedding))) i, embedding FROM embeddings), y AS (SELECT vec_id, label, i, embedding[i+1]::DOUBLE e FROM x),
c AS (SELECT label, i, avg(e) c FROM y GROUP BY ALL), d AS (SELECT label, vec_id, round(sqrt(sum((e - c) * (e - c))), 6) d FROM y JOIN c USING (label, i) GROUP BY ALL)
SELECT label, arg_min(vec_id, (d, vec_id)) medoid FROM d GROUP BY label""",
    "cycle_clusters": f"WITH {clusters(3)} SELECT label, vec_id, k::INT clustnum, round(sqrt(d), 6) distance FROM a3",
    "cycle_medoids": f"WITH {clusters(3)}, m AS (SELECT label, k, vec_id, round(sqrt(d), 6) d FROM d3) SELECT label, k::INT clustnum, arg_min(vec_id, (d, vec_id)) medoid, min(d) distance FROM m GROUP BY ALL",
    "property_filter_stats": f"SELECT coalesce({FAIL}, 'kept') first_fail, count(*) n FROM part GROUP BY 1",
    "kept_and_removed": f"SELECT p_partkey, {FAIL} IS NOT NULL OR regexp_matches(p_name, 'e$|^a|1') removed, {FAIL} first_fail, CASE WHEN p_name LIKE '%e' THEN 0 WHEN p_name LIKE 'a%' THEN 1 WHEN p_name LIKE '%1%' THEN 2 END pattern FROM part",
    "substructure_counts": "SELECT CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 0 WHEN text LIKE '%!!%' THEN 1 WHEN text LIKE '%the%' THEN 2 WHEN text LIKE '%que%' THEN 3 END pattern, count(*) n FROM documents GROUP BY 1",
    "pattern_table": """WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) p FROM benchmark), p AS MATERIALIZED (SELECT p FROM w WHERE regexp_full_match(p, '[a-z]{6,}')),
m AS MATERIALIZED (SELECT doc_id, p FROM documents, p WHERE contains(text, p)), f AS (SELECT p, count(*) n FROM (SELECT min(p) p FROM m GROUP BY doc_id) GROUP BY p)
SELECT m.p pattern, count(*) n_texts, any_value(coalesce(n, 0))::BIGINT n_first FROM m LEFT JOIN f USING (p) GROUP BY m.p""",
    "pattern_groups": "SELECT doc_id, lang FROM documents WHERE (text LIKE '%the%' OR text LIKE '%que%') AND text LIKE '%an%' AND NOT regexp_matches(text, '[0-9]') AND text NOT LIKE '%!!%'",
    "named_block_lists": """WITH l AS (SELECT unnest(CASE WHEN regexp_matches(p_name, 'o|a') AND p_name LIKE '%e%' AND p_name NOT LIKE 's%' THEN ['BB1', 'BB2'] ELSE [] END) list, p_partkey FROM part
UNION ALL SELECT 'BB3', p_partkey FROM part WHERE NOT regexp_matches(p_name, '[aeiou]{2}') AND p_name NOT LIKE '%x%')
SELECT list, count(*) n, min(p_partkey) first_part FROM l GROUP BY list""",
    "nearest_but_excluded": f"WITH {PAIRS} SELECT q, vec_id, label, score, rank FROM (SELECT q, vec_id, label, round(t, 6) score, row_number() OVER (PARTITION BY q ORDER BY round(t, 6) DESC, vec_id) rank FROM p WHERE vec_id % 3 <> 0) WHERE rank <= 3",
    "mass_cutoff": "SELECT p_partkey, p_brand FROM part WHERE p_retailprice <= 960 AND p_type IS NOT NULL AND p_type NOT IN ('FAIL', 'ENUMERATION_FAIL', 'NOSCHEMEFAIL') AND p_brand IN (SELECT p_brand FROM part WHERE p_size > 45)",
    "exclusion_list": "SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)",
    "library_size": f"WITH {BLOCKS} SELECT product(n)::DECIMAL(38,0) n_products FROM (SELECT cycle, count(*) n FROM b GROUP BY cycle)",
    "cycle_sizes": f"WITH {BLOCKS} SELECT cycle, count(*) n FROM b GROUP BY cycle ORDER BY cycle",
    "full_product": f"WITH {BLOCKS} SELECT x.bb_id bb1, y.bb_id bb2, count(*) n, min(x.bb_id || '.' || y.bb_id || '.' || z.bb_id) \"first\", sum(length(x.bb_id) + length(y.bb_id) + length(z.bb_id) + 2)::BIGINT letters FROM b x, b y, b z WHERE x.cycle = 'BB1' AND y.cycle = 'BB2' AND z.cycle = 'BB3' GROUP BY 1, 2",
    "sampled_product": f"""WITH RECURSIVE {BLOCKS}, k AS (SELECT cycle, bb_id, row_number() OVER (PARTITION BY cycle ORDER BY bb_id) - 1 pos FROM b),
z AS (SELECT *, a * b * c n, floor(sqrt(a * b * c - 1))::BIGINT + 1 low FROM (SELECT (SELECT count(*) FROM k WHERE cycle = 'BB1') a, (SELECT count(*) FROM k WHERE cycle = 'BB2') b, (SELECT count(*) FROM k WHERE cycle = 'BB3') c)),
w AS (SELECT * FROM ({feistel("SELECT i id, i // low hi, i % low lo, (n + low - 1) // low high, low, n FROM range(0, 500) r(i), z WHERE i < n")}) UNION ALL SELECT * FROM ({feistel("SELECT * FROM w WHERE hi * low + lo >= n")})),
s AS (SELECT id, hi * low + lo m FROM w WHERE hi * low + lo < n)
SELECT id sample_id, x.bb_id bb_1, y.bb_id bb_2, v.bb_id bb_3 FROM s, z JOIN k x ON x.cycle = 'BB1' AND x.pos = m // (b * c) JOIN k y ON y.cycle = 'BB2' AND y.pos = m // c % b JOIN k v ON v.cycle = 'BB3' AND v.pos = m % c""",
    "memoised_lookup": "SELECT l_orderkey, l_linenumber, l_partkey || '.' || l_suppkey product FROM lineitem",
    "lookup_with_nulls": "SELECT l_orderkey, l_linenumber, concat_ws('.', round(nullif(l_discount, 0) * 100)::INT::VARCHAR, l_returnflag) product FROM lineitem",
    "picklist_join": "SELECT c_custkey bb_id, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON o_custkey = c_custkey",
    "directory_union": "SELECT * FROM (SELECT c_custkey bb_id, c_name smiles FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier) WHERE bb_id IS NOT NULL AND smiles IS NOT NULL",
    "keep_first_product": "SELECT p_name, min(p_partkey) p_partkey FROM part GROUP BY p_name",
    "reaction_scheme": f"WITH {SCHEME} SELECT p_partkey, x3 product, CASE WHEN x3 IS NULL THEN 'FAIL' ELSE 'OK' END status, concat_ws('>', x1, x2, CASE WHEN NOT done THEN x3 END) trace FROM s3",
    "scheme_with_stops": """SELECT p_partkey, CASE WHEN p_size > 40 THEN p_brand || '+a' || CASE WHEN p_size = 45 THEN '' ELSE '=c!' END WHEN p_size > 30 THEN p_brand WHEN p_size > 20 THEN 'b-' || p_brand || '=c!' ELSE p_brand END product,
'OK' status, CASE WHEN p_size = 45 THEN 2 WHEN p_size > 40 OR p_size BETWEEN 21 AND 30 THEN 3 ELSE 1 END n_steps FROM part""",
    "scheme_products": f"""WITH {BLOCKS}, r AS (SELECT x.bb_id bb1, y.bb_id bb2, z.bb_id bb3 FROM b x, b y, b z WHERE x.cycle = 'BB1' AND y.cycle = 'BB2' AND z.cycle = 'BB3'),
s1 AS (SELECT *, CASE WHEN bb2 LIKE 'S%' THEN CASE WHEN bb1 LIKE 'Brand#1%' THEN 's' || bb1[8:] || '.' || bb2 END WHEN bb2 LIKE 'P%' THEN bb1 ELSE bb1[6:] || '-' || bb2 END p1, bb2 LIKE 'P%' done FROM r),
s2 AS (SELECT *, CASE WHEN p1 IS NULL THEN NULL WHEN done OR bb3 LIKE '4%' THEN p1 WHEN bb3[-1] IN ('0', '5') THEN CASE WHEN p1 LIKE '%E' THEN p1[:-2] || ':' || bb3 END ELSE p1 || '/' || bb3 END p2 FROM s1),
s3 AS (SELECT *, CASE WHEN NOT done AND p2 LIKE '%-%' THEN replace(p2, '-', '_') ELSE p2 END p3 FROM s2)
SELECT bb1, bb2, bb3, coalesce(p3, 'FAIL') full_smiles, CASE WHEN p3 IS NULL THEN 'FAIL' ELSE 'OK' END status,
  (CASE WHEN done OR p1 IS NULL THEN 0 ELSE 1 END + CASE WHEN done OR p2 IS NULL OR bb3 LIKE '4%' THEN 0 ELSE 1 END + CASE WHEN NOT done AND p2 LIKE '%-%' THEN 1 ELSE 0 END)::INT n_steps FROM s3""",
    "status_split": f"WITH {SCHEME} SELECT CASE WHEN x3 IS NULL THEN 'FAIL' ELSE 'OK' END status, count(*) n, count(x3) n_products FROM s3 GROUP BY 1",
    "deprotection_variants": "WITH v AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') w FROM conversations) SELECT conv_id, turn, 0 n, w[1] variant FROM v UNION ALL SELECT conv_id, turn, 1, w[len(w)] FROM v WHERE len(w) > 1",
    "partner_sample": "SELECT p_brand, least(20, (SELECT count(*) FROM (SELECT DISTINCT p_type, p_size FROM part))) n_partners, least(20, (SELECT count(*) FROM (SELECT DISTINCT p_type, p_size FROM part))) n_distinct FROM (SELECT DISTINCT p_brand FROM part)",
    "fragment_counts": "SELECT doc_id, len(string_split(text, '.')) n_fragments FROM documents",
    "stripped_stereo": r"SELECT page_id, length(regexp_replace(url, '[@/\\]+', '', 'g')) n_url, length(regexp_replace(html, '[@/\\]+', '', 'g')) n_html FROM pages",
    "standard_columns": "SELECT o_orderkey id, o_totalprice rank FROM orders",
    "property_histogram": """SELECT CASE WHEN p_size = 45 THEN 8 ELSE floor(p_size / 5)::BIGINT END bin, count(*) n, 'size' property FROM part WHERE p_size BETWEEN 0 AND 45 GROUP BY 1
UNION ALL SELECT CASE WHEN p_retailprice = 995 THEN 18 ELSE floor((p_retailprice - 900) / 5)::BIGINT END, count(*), 'price' FROM part WHERE p_retailprice BETWEEN 900 AND 995 GROUP BY 1""",
    "colored_union": "SELECT 'red' color, count(*) n, round(sum(c_acctbal), 2) total FROM customer UNION ALL SELECT 'blue', count(*), round(sum(s_acctbal), 2) FROM supplier",
}
SQL["indexed_top_k"] = SQL["top_k_tanimoto"]
