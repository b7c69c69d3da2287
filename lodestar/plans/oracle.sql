-- name: resolve_one
SELECT concat('customer:', c_custkey) AS iri, c_name AS name FROM customer WHERE c_custkey = 17;

-- name: resolve_batch_keep_missing
SELECT r.pos, r.iri, c.c_name AS name FROM (VALUES (0,'customer:5'),(1,'customer:2'),(2,'customer:999999999')) r(pos, iri) LEFT JOIN customer c ON concat('customer:', c.c_custkey) = r.iri;

-- name: resolve_batch_drop_missing
SELECT concat('customer:', c_custkey) AS iri, c_name AS name FROM customer WHERE concat('customer:', c_custkey) IN ('customer:5','customer:2','customer:999999999');

-- name: resolve_polymorphic
SELECT concat('region:', r_regionkey) AS iri, 'Region' AS type, r_name AS name FROM region UNION ALL SELECT concat('nation:', n_nationkey), 'Nation', n_name FROM nation;

-- name: route_by_prefix
SELECT split_part(iri, ':', 1) AS prefix, count(*) AS n FROM (SELECT concat('region:', r_regionkey) AS iri FROM region UNION ALL SELECT concat('nation:', n_nationkey) FROM nation UNION ALL SELECT concat('supplier:', s_suppkey) FROM supplier) t GROUP BY 1;

-- name: fanout_union_dups
SELECT iri, name FROM (SELECT concat('nation:', n_nationkey) AS iri, n_name AS name FROM nation UNION ALL SELECT concat('nation:', n_nationkey), n_name FROM nation) t WHERE name = 'NATION_3';

-- name: first_non_null_store
SELECT r.iri, coalesce(a.n_name, b.n_name) AS name FROM (VALUES ('nation:3'),('nation:20')) r(iri) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) a ON concat('nation:', a.n_nationkey) = r.iri LEFT JOIN nation b ON concat('nation:', b.n_nationkey) = r.iri;

-- name: filter_eq
SELECT concat('customer:', c_custkey) AS iri FROM customer WHERE c_mktsegment = 'BUILDING';

-- name: filter_ne_store_semantics
SELECT event_id FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events) t WHERE kind IS NOT NULL AND kind <> 'view';

-- name: filter_ne_list_semantics
SELECT event_id FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events) t WHERE kind IS DISTINCT FROM 'view';

-- name: filter_lt
SELECT concat('part:', p_partkey) AS iri FROM part WHERE p_size < 10;

-- name: filter_le_string
SELECT concat('nation:', n_nationkey) AS iri FROM nation WHERE n_name <= 'NATION_15';

-- name: filter_gt
SELECT concat('customer:', c_custkey) AS iri FROM customer WHERE c_acctbal > 5000.0;

-- name: filter_ge
SELECT event_id FROM events WHERE value >= 100.0;

-- name: filter_and
SELECT concat('customer:', c_custkey) AS iri, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000.0;

-- name: filter_or
SELECT concat('customer:', c_custkey) AS iri FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3;

-- name: filter_nested_bool
SELECT concat('customer:', c_custkey) AS iri FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY') AND (c_acctbal < 0.0 OR c_nationkey = 7);

-- name: filter_string_mini_query
SELECT concat('nation:', n_nationkey) AS iri FROM nation WHERE n_name = 'NATION_7';

-- name: filter_json_number
SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90;

-- name: filter_json_type_guard
SELECT count(*) AS n FROM events WHERE json_type(props, '$.k') = 'VARCHAR' AND json_extract_string(props, '$.k') = '69';

-- name: filter_json_key_presence
SELECT count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL;

-- name: list_lookup_iri
SELECT concat('supplier:', s_suppkey) AS iri, s_name AS name FROM supplier WHERE s_suppkey = 3;

-- name: deref_one
SELECT concat('order:', o_orderkey) AS iri, c_name AS customer_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey;

-- name: deref_missing_keeps_iri
SELECT t.iri, t.ref, n_name AS ref_name FROM (VALUES ('x:1','nation:4'),('x:2','nation:777')) t(iri, ref) LEFT JOIN nation ON concat('nation:', n_nationkey) = t.ref;

-- name: deref_list_positional
SELECT t.iri, t.pos, t.ref, n_name AS ref_name FROM (VALUES ('x:1',0,'nation:4'),('x:1',1,'nation:777'),('x:1',2,'nation:2'),('x:1',3,'nation:4')) t(iri, pos, ref) LEFT JOIN nation ON concat('nation:', n_nationkey) = t.ref;

-- name: nav_three_hop
SELECT r_name AS region, n_name AS nation, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2;

-- name: nav_chain_filter
SELECT concat('customer:', c_custkey) AS iri FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA' AND n_name = 'NATION_2' AND c_mktsegment = 'BUILDING';

-- name: flatmap_projection
SELECT n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name = 'ASIA';

-- name: flatmap_keeps_null_scalar
SELECT CASE WHEN event_type = 'purchase' THEN value END AS amount FROM events WHERE user_id = 13;

-- name: iri_only_projection
SELECT concat('order:', o_orderkey) AS iri, concat('customer:', o_custkey) AS customer FROM orders WHERE o_orderstatus = 'F';

-- name: bgp_two_hop
SELECT c_name AS s_name, n_name AS o_name FROM customer JOIN nation ON c_nationkey = n_nationkey;

-- name: bgp_three_hop
SELECT DISTINCT s_name AS supplier, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey;

-- name: bgp_star
SELECT concat('customer:', c_custkey) AS s, c_name AS name, c_mktsegment AS segment, concat('nation:', c_nationkey) AS nation FROM customer;

-- name: construct_subject
SELECT 'nation:3' AS s, p, o FROM (SELECT 'rdf:type' AS p, 'ex:Nation' AS o UNION ALL SELECT 'ex:name', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'ex:region', concat('region:', n_regionkey) FROM nation WHERE n_nationkey = 3) t;

-- name: triples_per_predicate
SELECT p, count(*) AS n FROM (SELECT 'ex:name' AS p FROM customer UNION ALL SELECT 'ex:nation' FROM customer UNION ALL SELECT 'rdf:type' FROM customer UNION ALL SELECT 'ex:name' FROM nation UNION ALL SELECT 'ex:region' FROM nation UNION ALL SELECT 'rdf:type' FROM nation) t GROUP BY 1;

-- name: sparql_optional
SELECT concat('customer:', c_custkey) AS c, concat('order:', o_orderkey) AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000.0) t ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_orderkey IS NOT NULL UNION ALL SELECT concat('customer:', c_custkey), NULL FROM customer WHERE c_nationkey = 3 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000.0);

-- name: sparql_union
SELECT s_name AS name FROM supplier WHERE s_nationkey = 1 UNION ALL SELECT c_name FROM customer WHERE c_nationkey = 1;

-- name: sparql_minus
SELECT concat('nation:', n_nationkey) AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000.0);

-- name: sparql_exists
SELECT concat('customer:', c_custkey) AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT');

-- name: sparql_order_limit
SELECT DISTINCT c_name AS name FROM customer ORDER BY name LIMIT 10;

-- name: sparql_group_count
SELECT concat('nation:', c_nationkey) AS nation, count(*) AS n FROM customer GROUP BY 1;

-- name: sparql_path_plus
WITH RECURSIVE e(s, o) AS (SELECT concat('customer:', c_custkey), concat('nation:', c_nationkey) FROM customer UNION ALL SELECT concat('nation:', n_nationkey), concat('region:', n_regionkey) FROM nation), r(s, o) AS (SELECT s, o FROM e UNION ALL SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT DISTINCT s, o FROM r;

-- name: upsert_documents
SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey NOT IN (3, 900) UNION ALL SELECT * FROM (VALUES (3, 'RENAMED'), (900, 'NEW')) v(id, name);

-- name: rdf_replace_subject
SELECT s, p, o FROM (SELECT concat('nation:', n_nationkey) AS s, 'ex:name' AS p, n_name AS o FROM nation UNION ALL SELECT concat('nation:', n_nationkey), 'ex:region', concat('region:', n_regionkey) FROM nation) t WHERE s <> 'nation:3' UNION ALL SELECT 'nation:3', 'ex:name', 'RENAMED';

-- name: graph_union_distinct
SELECT concat('customer:', user_id) AS s, 'ex:did' AS p, event_type AS o FROM events UNION SELECT concat('customer:', user_id), 'ex:did', event_type FROM events WHERE value > 100.0;

-- name: tr_expand_iri
SELECT concat('https://example.com/nation/', n_nationkey) AS iri FROM nation;

-- name: tr_compact_iri
SELECT replace(concat('https://example.com/nation/', n_nationkey), 'https://example.com/nation/', 'nation:') AS iri FROM nation;

-- name: tr_alias_rename
SELECT concat('supplier:', s_suppkey) AS s, 'schema:name' AS p, s_name AS o FROM supplier UNION ALL SELECT concat('nation:', n_nationkey), 'schema:name', n_name FROM nation;

-- name: tr_alias_class
SELECT concat('customer:', c_custkey) AS id, 'schema:Person' AS type FROM customer;

-- name: tr_reverse_edge
SELECT concat('region:', n_regionkey) AS s, 'ex:hasNation' AS p, concat('nation:', n_nationkey) AS o FROM nation;

-- name: tr_language_tag
SELECT concat('doc:', doc_id) AS s, source AS o, 'en' AS lang FROM documents;

-- name: tr_flatten_regroup
SELECT concat('customer:', user_id) AS id, count(DISTINCT event_type) AS n_values FROM events GROUP BY 1;

-- name: json_exclude_defaults
SELECT concat('order:', o_orderkey) AS iri, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS status FROM orders;

-- name: json_restore_defaults
SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'unknown') AS kind FROM events;

-- name: cast_remove_extra
SELECT concat('supplier:', s_suppkey) AS iri, 'Party' AS type, s_name AS name FROM supplier;

-- name: cast_none_to_default
SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN value END, 0.0) AS amount FROM events;

-- name: required_iri_violations
SELECT iri FROM (SELECT concat('event:', event_id) AS iri, CASE WHEN event_type <> 'error' THEN concat('customer:', user_id) END AS usr FROM events) t WHERE usr IS NULL;

-- name: dangling_refs
SELECT concat('event:', event_id) AS iri FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey >= 100);

-- name: ctl_strip_fields
SELECT concat('customer:', c_custkey) AS iri, c_name AS name FROM customer;

-- name: ctl_type_merge
SELECT concat('nation:', n_nationkey) AS iri, t.pos, t.type FROM nation CROSS JOIN (VALUES (0,'ex:A'),(1,'ex:B')) t(pos, type);

-- name: ctl_unique_preferred
SELECT k.type, CASE WHEN count(c.ctl) = 1 THEN max(c.ctl) ELSE max(k.model) END AS cls FROM (VALUES ('A','ModelA'),('B','ModelB'),('C','ModelC')) k(type, model) LEFT JOIN (VALUES ('A','CtlA'),('B','CtlB1'),('B','CtlB2')) c(type, ctl) ON k.type = c.type GROUP BY k.type;

-- name: jt_unique_array
SELECT DISTINCT concat('customer:', user_id) AS s, event_type AS item FROM events;

-- name: jt_enum_titles
SELECT event_id, CASE event_type WHEN 'view' THEN 'Viewed' WHEN 'click' THEN 'Clicked' ELSE event_type END AS title FROM events;

-- name: st_url_tail
SELECT page_id, split_part(list_extract(string_split(url, '/'), -1), '?', 1) AS tail FROM pages;

-- name: cred_best_match
SELECT page_id, k FROM (SELECT page_id, k, row_number() OVER (PARTITION BY page_id ORDER BY length(k) DESC) AS rn FROM pages JOIN (VALUES ('example.com'),('example.net'),('http://'),('https://'),('example.org/es')) c(k) ON contains(url, k)) t WHERE rn = 1;

-- name: perf_chain
SELECT concat('ex:e2-', c.i) AS iri, concat('Entity 2-', c.i) AS name FROM range(333) a(i), range(333) b(i), range(333) c(i) WHERE concat('Entity 0-', a.i) = 'Entity 0-50' AND concat('Entity 1-', b.i) = 'Entity 1-50' AND concat('Entity 2-', c.i) = 'Entity 2-50';

-- name: perf_links
SELECT count(*) AS n_links FROM range(333) a(x), range(333) b(y), (VALUES (0),(1)) l(layer);

-- name: sparql_literal_or_iri
SELECT concat('nation:', n_nationkey) AS s, concat('region:', n_regionkey) AS o FROM nation;

-- name: sparql_disconnected
SELECT 1 AS k, concat('nation:', n_nationkey) AS n, NULL::VARCHAR AS r FROM nation WHERE EXISTS (SELECT * FROM region WHERE r_name = 'ASIA') UNION ALL SELECT 2, concat('nation:', n_nationkey), NULL FROM nation WHERE NOT EXISTS (SELECT * FROM region WHERE r_name = 'ASIA') UNION ALL SELECT 3, concat('nation:', n_nationkey), 'region:' || r_regionkey FROM nation LEFT JOIN region ON r_name = 'NOWHERE';

-- name: documents_by_class
SELECT concat('nation:', n_nationkey) AS iri, n_name AS name, concat('region:', n_regionkey) AS region FROM nation UNION ALL SELECT concat('region:', r_regionkey), r_name, NULL FROM region;
