"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from tomolake.operators import frames
from tomolake.plans import registry

_CELLS = """cells AS (SELECT vec_id, (i // 16)::INT AS x, ((i // 4) % 4)::INT AS y, (i % 4)::INT AS z, v::DOUBLE AS value
 FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings))"""
_PLACED = "placed AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)"
_SIDES = """a AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer WHERE c_acctbal > 0),
 b AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer WHERE c_custkey % 3 = 0)"""
_VOX = "vox AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def _list(values) -> str:
    return ", ".join(str(v) for v in values)


def _histogram(bins: int, lo: float, hi: float) -> str:
    return f"""WITH {_VOX}, hits AS (SELECT vec_id, least(floor((v - ({lo})) / {(hi - lo) / bins!r}), {bins - 1})::INT AS bin, count(*) AS n FROM vox WHERE v >= {lo} AND v <= {hi} GROUP BY 1, 2)
 SELECT e.vec_id, r.bin::INT AS bin, coalesce(h.n, 0)::BIGINT AS n FROM embeddings e CROSS JOIN (SELECT unnest(range({bins}))::INT AS bin) r LEFT JOIN hits h ON h.vec_id = e.vec_id AND h.bin = r.bin"""


def _series_case() -> str:
    from tomolake.functions.naming import NAME_PARTS, SERIES

    ends = " ".join(f"WHEN upper(list_extract(string_split(name, '_'), -1)) = '{s.upper()}' THEN '{s}'" for s in SERIES)
    parts = " ".join(f"WHEN contains(upper(name), '{p}') THEN '{s}'" for p, s in NAME_PARTS)
    return f"CASE {ends} {parts} ELSE 'unknown' END"


def oracle_sql() -> dict[str, str]:
    names = ", ".join(f"'{n}'" for n in registry.NAMES)
    return {
        "meta_scan": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0",
        "subject_filter": "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'",
        "subject_filter_in": "SELECT c_custkey, c_nationkey FROM customer WHERE (c_nationkey IN (1, 2, 3) OR c_acctbal < -500) AND NOT c_mktsegment = 'MACHINERY'",
        "view_filter_chain": "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 1000 AND c_nationkey <= 10",
        "volume_filter": "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus <> 'P'",
        "subject_filter_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')",
        "iloc_slice": f"WITH {_PLACED} SELECT * FROM placed WHERE pos >= 10 AND pos < 50",
        "iloc_step": f"WITH {_PLACED} SELECT * FROM placed WHERE pos < 200 AND pos % 7 = 0",
        "iloc_negative": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 5",
        "iloc_mask": f"WITH {_PLACED} SELECT * FROM placed WHERE pos % 100 = 3",
        "loc_list": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 77, 130)",
        "sel_subject": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 22)",
        "head_n": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10",
        "tail_n": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 10",
        "lazy_filter_head_rootpos": "SELECT o_orderkey, pos FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos < 100 AND o_totalprice > 150000",
        "sample_seeded": f"SELECT c_custkey, pos FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) WHERE pos IN ({_list(frames.sample_positions(150, 20, 42))})",
        "subject_volume_join": "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
        "obs_ids_json": "SELECT o_custkey, to_json(list_sort(list(o_orderkey::VARCHAR)))::VARCHAR AS obs_ids FROM orders GROUP BY 1",
        "merge_obs_ids_default": """SELECT c_custkey, coalesce(j, '[]') AS obs_ids FROM customer LEFT JOIN
 (SELECT o_custkey, to_json(list_sort(list(o_orderkey::VARCHAR)))::VARCHAR AS j FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
        "orphan_observations": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)",
        "missing_subjects": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
        "duplicate_obs_ids": "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
        "cross_collection_duplicates": """SELECT o_orderkey, count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1 HAVING count(*) > 1""",
        "validate_counts": "SELECT 'customer' AS tbl, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'embeddings', count(*) FROM embeddings",
        "study_faults": """WITH meta AS (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0),
 obs AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 250000)
 SELECT 'observation without subject' AS fault, o_orderkey::VARCHAR AS key FROM obs WHERE o_custkey NOT IN (SELECT c_custkey FROM meta)
 UNION ALL SELECT 'obs_id used twice', o_orderkey::VARCHAR FROM obs GROUP BY o_orderkey HAVING count(*) > 1""",
        "groupby_subject": "SELECT o_custkey, count(*) AS n_volumes, min(o_orderkey) AS first_obs, max(o_orderkey) AS last_obs FROM orders GROUP BY 1",
        "subjects_first_seen": f"WITH {_PLACED} SELECT o_custkey, min(pos) AS first_pos FROM placed GROUP BY 1",
        "describe_labels": "SELECT 'c_mktsegment' AS label, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2",
        "index_intersection": f"WITH {_SIDES} SELECT * FROM a WHERE key IN (SELECT key FROM b)",
        "index_union": f"WITH {_SIDES} SELECT key, 0 AS side, pos FROM a UNION ALL SELECT key, 1, pos FROM b WHERE key NOT IN (SELECT key FROM a)",
        "index_difference": f"WITH {_SIDES} SELECT * FROM a WHERE key NOT IN (SELECT key FROM b)",
        "index_symdiff": f"WITH {_SIDES} SELECT key, pos, 0 AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, pos, 1 FROM b WHERE key NOT IN (SELECT key FROM a)",
        "index_aligned": f"WITH {_SIDES} SELECT coalesce(a.pos, b.pos) AS pos, a.key AS \"left\", b.key AS \"right\" FROM a FULL JOIN b ON a.pos = b.pos WHERE a.key IS DISTINCT FROM b.key",
        "index_subset": f"WITH {_SIDES} SELECT NOT EXISTS (SELECT 1 FROM b WHERE key NOT IN (SELECT key FROM a)) AS is_subset",
        "align_three": f"WITH {_SIDES} SELECT key, pos FROM a WHERE key IN (SELECT key FROM b) AND key IN (SELECT c_custkey FROM customer WHERE c_nationkey < 15)",
        "acquisition_ids": """SELECT o_orderkey, o_custkey || '_CT' || CASE WHEN k = 0 THEN '' ELSE '_acq-' || k END AS obs_id
 FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)""",
        "series_type": f"SELECT p_partkey, name, {_series_case()} AS series FROM (SELECT p_partkey, list_extract([{names}], (p_partkey % {len(registry.NAMES)} + 1)::INT) AS name FROM part)",
        "file_stems": "SELECT p_partkey, p_partkey::VARCHAR AS stem FROM part",
        "spatial_units": "SELECT p_partkey, CASE p_size & 7 WHEN 1 THEN 'm' WHEN 2 THEN 'mm' WHEN 3 THEN 'um' ELSE 'unknown' END AS units FROM part",
        "affine_parse": "SELECT p_partkey, (2 * p_size + 1)::DOUBLE AS trace3, p_size::DOUBLE AS z_offset FROM part",
        "tuple_parse": "SELECT p_partkey, p_size::DOUBLE AS a, 2.5::DOUBLE AS b, 3 AS n FROM part",
        "upsert_meta": """SELECT c_custkey, c_name, CASE WHEN c_custkey <= 5 THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal FROM customer
 UNION ALL SELECT 900000001, NULL, 12.5""",
        "delete_meta": "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_nationkey = 3)",
        "add_column_fill": "SELECT c_custkey, 'A1' AS site FROM customer",
        "drop_column": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer",
        "append_obs": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders",
        "axial_slice": f"WITH {_CELLS} SELECT vec_id, x, y, round(value, 6) AS value FROM cells WHERE z = 2",
        "sagittal_slice": f"WITH {_CELLS} SELECT vec_id, y, z, round(value, 6) AS value FROM cells WHERE x = 1",
        "coronal_slice": f"WITH {_CELLS} SELECT vec_id, x, z, round(value, 6) AS value FROM cells WHERE y = 3",
        "roi_box": f"WITH {_CELLS} SELECT vec_id, x, y, z, round(value, 6) AS value FROM cells WHERE x BETWEEN 1 AND 2 AND y < 2 AND z >= 2",
        "tile_roundtrip": "SELECT vec_id, unnest(range(64)) AS p, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings",
        "tile_box": f"WITH {_CELLS} SELECT vec_id AS obs_id, count(*) AS n, round(sum(value), 4) AS total FROM cells WHERE x BETWEEN 1 AND 2 AND y < 2 AND z >= 2 GROUP BY 1",
        "tile_statistics": f"""WITH {_VOX} SELECT vec_id, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
 round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.9), 6) AS p90 FROM vox GROUP BY 1""",
        "tile_histogram": _histogram(8, -0.4, 0.4).replace("r.bin::INT AS bin", "r.bin::BIGINT AS bin"),
        "volume_statistics": f"""WITH {_VOX} SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
 round(quantile_cont(v, 0.5), 6) AS median FROM vox GROUP BY 1""",
        "volume_percentiles": f"WITH {_VOX} SELECT vec_id, " + ", ".join(f"round(quantile_cont(v, {p / 100}), 6) AS p{p}" for p in (5, 25, 75, 95)) + " FROM vox GROUP BY 1",
        "histogram": _histogram(10, -1.0, 1.0),
        "histogram_range": _histogram(4, -0.1, 0.1),
        "uniform_shape": "SELECT len(embedding) AS n_voxels, count(*) AS n FROM embeddings GROUP BY 1",
        "foreground_coords": f"WITH {_CELLS} SELECT vec_id, x, y, z FROM cells WHERE value > 0.2",
        "reorient_las": f"WITH {_CELLS} SELECT vec_id, 3 - x AS x, y, z, round(value, 6) AS value FROM cells",
        "reorient_lps": f"WITH {_CELLS} SELECT vec_id, 3 - x AS x, 3 - y AS y, z, round(value, 6) AS value FROM cells",
        "map_normalize": f"""WITH {_CELLS}, m AS (SELECT vec_id, avg(value) AS mu, stddev_pop(value) AS sd FROM cells GROUP BY 1)
 SELECT vec_id, (x * 16 + y * 4 + z)::BIGINT AS p, round((value - mu) / sd, 5) AS value FROM cells JOIN m USING (vec_id)""",
        "map_obs_updates": f"WITH {_VOX} SELECT vec_id, round(max(v), 6) AS peak, avg(v) > 0 AS positive FROM vox GROUP BY 1",
        "map_chain": f"WITH {_VOX} SELECT vec_id, count(*) FILTER (WHERE v > 0) AS kept, round(sum(greatest(v, 0)) * count(*) FILTER (WHERE v > 0), 4) AS value FROM vox GROUP BY 1",
        "map_batches": f"""WITH {_VOX}, t AS (SELECT vec_id, sum(v) AS total FROM vox GROUP BY 1), p AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 8 AS batch FROM t)
 SELECT vec_id, batch, round(sum(total) OVER (PARTITION BY batch), 4) AS in_batch FROM p""",
        "foreground_patch": f"""WITH {_CELLS}, b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, x, y, z) AS k FROM cells)
 SELECT vec_id, least(greatest(x - 1, 0), 2)::BIGINT AS x, least(greatest(y - 1, 0), 2)::BIGINT AS y, least(greatest(z - 1, 0), 2)::BIGINT AS z FROM b WHERE k = 1""",
        "slice2d_samples": "SELECT pos * 4 + z AS idx, vec_id, z FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) CROSS JOIN (SELECT unnest(range(4)) AS z)",
        "segmentation_pairs": f"WITH {_VOX} SELECT vec_id, count(*) AS n, round(sum(v), 5) AS total FROM vox WHERE v > 0.1 GROUP BY 1",
        "label_join": "SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
        "train_batches": "SELECT * FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS batch FROM embeddings) WHERE batch < (SELECT count(*) // 16 FROM embeddings)",
        "rank_shards": """WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings),
 q AS (SELECT vec_id, pos FROM p UNION ALL SELECT vec_id, pos + n FROM p, n WHERE pos < (3 - n % 3) % 3) SELECT vec_id, pos, (pos % 3)::INT AS rank FROM q""",
        "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "event_users": "SELECT DISTINCT user_id FROM events",
        "flagship": f"""WITH {_CELLS}, k AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0)
 SELECT vec_id, c_mktsegment, round(avg(value), 6) AS mean, round(sum(value) FILTER (WHERE z = 2), 4) AS mid_total FROM cells JOIN k ON vec_id = c_custkey GROUP BY 1, 2""",
    }
