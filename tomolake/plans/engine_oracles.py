"""DuckDB SQL with the results of the queries in ``engine``; values that no table holds are written out."""

from __future__ import annotations


def _set(name: str, prefix: str, where: str = "", value: str = "v") -> str:
    rows = f"SELECT 's' || lpad((vec_id % 150)::VARCHAR, 9, '0') AS obs_subject_id, '{prefix}' || lpad(vec_id::VARCHAR, 9, '0') AS obs_id, vec_id, label, embedding FROM embeddings {where}"
    return f"""{name} AS (SELECT * FROM ({rows})), {name}_pos AS (SELECT *, row_number() OVER (ORDER BY obs_subject_id, obs_id) - 1 AS pos FROM {name}),
 {name}_n AS (SELECT count(*) AS n FROM {name}),
 {name}_cells AS (SELECT obs_subject_id, obs_id, vec_id, label, i AS p, (i // 16)::INT AS x, ((i // 4) % 4)::INT AS y, (i % 4)::INT AS z, {value} AS value
  FROM (SELECT *, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM {name}))"""


_CT, _MR, _SEG = _set("ct", "CT"), _set("mr", "MR", "WHERE vec_id % 2 = 0", "-v"), _set("seg", "SG", "", "(v > 0.1)::INT")
_META = """meta AS (SELECT 's' || lpad(c_custkey::VARCHAR, 9, '0') AS obs_subject_id, c_acctbal, c_mktsegment, c_nationkey FROM customer),
 meta_pos AS (SELECT *, row_number() OVER (ORDER BY obs_subject_id) - 1 AS pos FROM meta)"""
_ALL = "every AS (SELECT obs_subject_id, obs_id, 'CT' AS collection FROM ct UNION ALL SELECT obs_subject_id, obs_id, 'MR' FROM mr)"
_STUDY = f"{_CT}, {_MR}, {_META}, {_ALL}"
_JSON = "to_json(list_sort(list(obs_id)))::VARCHAR"
_NAME = "'p' || lpad(vec_id::VARCHAR, 9, '0')"


def _values(columns: str, *rows: tuple) -> str:
    show = lambda v: "TRUE" if v is True else "FALSE" if v is False else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    cast = ", ".join(f"{n}::{k} AS {n}" for n, k in zip(names, kinds, strict=True))
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({', '.join(names)})"


def _ct(sql: str) -> str:
    return f"WITH {_CT} {sql}"


def _study(sql: str) -> str:
    return f"WITH {_STUDY} {sql}"


def _seg(sql: str) -> str:
    return f"WITH {_CT}, {_SEG} {sql}"


def _obs_ids(obs: str, meta: str) -> str:
    return f"SELECT m.obs_subject_id, coalesce(j, '[]') AS obs_ids FROM ({meta}) m LEFT JOIN (SELECT obs_subject_id, {_JSON} AS j FROM ({obs}) GROUP BY 1) USING (obs_subject_id)"


def _sums(where: str) -> str:
    return _ct(f"SELECT obs_id, count(*) AS n, round(sum(value), 4) AS total FROM ct_cells WHERE {where} GROUP BY 1")


_ONE = "SELECT x, y, z, value FROM ct_cells WHERE obs_id = 'CT000000300'"


def _read(name: str, where: str) -> str:
    return f"SELECT '{name}' AS read, count(*) AS n, round(sum(value), 4) AS total FROM one WHERE {where}"


def oracle_sql() -> dict[str, str]:
    ct_obs = "SELECT obs_subject_id, obs_id FROM ct_pos"
    half_pairs = f"{_NAME} || '_T1w'"
    return {
        "open_collection": _ct("SELECT obs_subject_id, obs_id, label FROM ct"),
        "open_study": _study(f"SELECT obs_subject_id, c_mktsegment, obs_ids FROM meta JOIN ({_obs_ids('SELECT * FROM every', 'SELECT * FROM meta')}) USING (obs_subject_id)"),
        "open_volume": _ct("SELECT obs_id, 4::BIGINT AS nx, 4::BIGINT AS nz, '<f4' AS dtype, 'axial' AS tiles FROM ct"),
        "source_formats": _values(
            "source VARCHAR, format VARCHAR", ("directory", "nifti"), ("pattern", "nifti"), ("file", "nifti"), ("pairs", "nifti"), ("series", "dicom"), ("series pairs", "dicom"), ("none", "error"),
            ("nowhere", "error"), ("text pattern", "error"),
        ),
        "nifti_resolve": f"SELECT {_NAME} || '_T1w.nii' AS file, {_NAME} AS subject FROM embeddings",
        "nifti_pairs": f"SELECT {half_pairs} AS subject, vec_id % 3 = 0 AS has_label FROM embeddings",
        "dicom_resolve": f"SELECT {_NAME} AS directory, {_NAME} AS subject FROM embeddings",
        "nifti_collection": f"""SELECT {half_pairs} AS obs_subject_id, {half_pairs} || '_T1w' AS obs_id, 'T1w' AS series_type, '(4, 4, 4)' AS dimensions, '(1.0, 1.0, 2.0)' AS voxel_spacing, 16 AS datatype,
 'mm' AS spatial_units, 'RAS' AS axcodes, 'sform' AS orientation_source FROM embeddings""",
        "nifti_voxels": f"SELECT {half_pairs} || '_T1w' AS obs_id, 64::BIGINT AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
        "nifti_headers": f"SELECT {half_pairs} AS stem, '(4, 4, 4)' AS dimensions, 32 AS bitpix, 1 AS sform_code, 2.0::DOUBLE AS dz FROM embeddings",
        "dicom_collection": f"""SELECT {_NAME} AS obs_subject_id, {_NAME} || '_scan' AS obs_id, 'CT' AS modality, '(4, 4, 4)' AS dimensions, '(1.0, 1.0, 2.0)' AS voxel_spacing, 'LPS' AS axcodes,
 'dicom_iop' AS orientation_source FROM embeddings""",
        "dicom_voxels": _ct(f"SELECT {_NAME} || '_scan' AS obs_id, z::BIGINT AS z, sum(floor(value * 1000 + 2000))::BIGINT AS total FROM ct_cells GROUP BY vec_id, z"),
        "obs_by_position": f"SELECT {half_pairs} AS obs_subject_id, {half_pairs} || '_T1w' AS obs_id, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM embeddings",
        "study_from_images": f"SELECT {half_pairs} AS obs_subject_id, {half_pairs} || '_T1w' AS obs_id, 'T1w' AS collection FROM embeddings UNION ALL SELECT {_NAME}, {_NAME} || '_scan', 'scan' FROM embeddings",
        "study_from_collections": _study("SELECT * FROM every"),
        "empty_volume": _values("obs_id VARCHAR, n BIGINT, total DOUBLE", ("v1", 60, 0.0)),
        "uri_life": _values("what VARCHAR, is_so BOOLEAN", ("before", True), ("deleted", True), ("after", False)),
        "collection_iloc": _ct(f"{ct_obs} WHERE pos >= 10 AND pos < 50"),
        "collection_iloc_list": _ct(f"{ct_obs}, ct_n WHERE pos IN (1, 3, 77) OR pos = n - 1"),
        "study_iloc": _study("SELECT obs_subject_id, c_nationkey FROM meta_pos WHERE pos < 120 AND pos % 7 = 0"),
        "study_loc": _study("SELECT obs_subject_id, c_nationkey FROM meta WHERE obs_subject_id IN ('s000000002', 's000000077', 's000000149')"),
        "collection_loc": _ct("SELECT obs_subject_id, obs_id, label FROM ct WHERE vec_id IN (2, 300)"),
        "brackets": _study("""SELECT 'place' AS key, obs_id AS selected FROM ct_pos WHERE pos = 3 UNION ALL SELECT 'id', 'CT000000300' UNION ALL SELECT 'last', obs_id FROM ct_pos, ct_n WHERE pos = n - 1
 UNION ALL SELECT 'ids', obs_id FROM ct WHERE vec_id IN (2, 9) UNION ALL SELECT 'range', obs_id FROM ct_pos WHERE pos IN (2, 3, 4) UNION ALL SELECT 'subject', 's000000007'
 UNION ALL SELECT 'subjects', obs_subject_id FROM meta_pos WHERE pos < 2 UNION ALL SELECT 'missing', 'KeyError' UNION ALL SELECT 'missing subject', 'KeyError'"""),
        "collection_sel": _ct("SELECT obs_subject_id, obs_id FROM ct WHERE vec_id % 150 = 7"),
        "lazy_filters": _ct("SELECT obs_subject_id, obs_id, label FROM ct WHERE label >= 3 AND (vec_id % 150) % 6 = 0"),
        "lazy_many_subjects": _ct("SELECT obs_subject_id, obs_id FROM ct WHERE vec_id % 150 >= 5 AND label < 5"),
        "lazy_iloc_loc": _ct(f"{ct_obs} WHERE pos < 200 AND label IN (1, 2)"),
        "lazy_head_of_root": _ct("SELECT obs_id, 'head' AS side FROM ct_pos WHERE pos < 100 AND label >= 5 UNION ALL SELECT obs_id, 'tail' FROM ct_pos, ct_n WHERE pos >= n - 60 AND label >= 5"),
        "some_collections": _values("study VARCHAR, collection VARCHAR", ("root", "CT"), ("root", "MR"), ("view", "MR"), ("missing", "KeyError")),
        "collection_by_name": _study("SELECT obs_subject_id, obs_id FROM mr UNION ALL SELECT obs_subject_id, obs_id FROM ct WHERE label = 9"),
        "one_volume": _study("SELECT p, round(value, 6) AS value FROM mr_cells WHERE vec_id = 42"),
        "row_lookup": _study("SELECT 'subject' AS kind, obs_subject_id AS key, c_nationkey::BIGINT AS value FROM meta WHERE obs_subject_id = 's000000007' UNION ALL SELECT 'volume', obs_id, label::BIGINT FROM ct WHERE vec_id = 300"),
        "view_obs": _study("""SELECT obs_id, 'CT' AS kind FROM ct WHERE obs_subject_id IN (SELECT obs_subject_id FROM meta WHERE c_acctbal > 3000 AND c_nationkey < 12)
 UNION ALL SELECT obs_id, 'MR' FROM mr WHERE label <= 4 AND obs_subject_id IN (SELECT obs_subject_id FROM meta WHERE c_acctbal > 3000 AND c_nationkey < 12)"""),
        "view_guard": _values("what VARCHAR, is_so BOOLEAN", *((k, True) for k in (
            "study is none", "view is one", "collection of a view is one", "copy of a view is one", "view refuses a collection", "view refuses renaming", "view refuses volumes", "view refuses an id",
        ))),
        "view_algebra": _study("""SELECT CASE WHEN a AND b THEN 'and' ELSE 'minus' END AS op, obs_subject_id FROM f WHERE a UNION ALL SELECT 'xor', obs_subject_id FROM f WHERE a <> b
 UNION ALL SELECT 'or', obs_subject_id FROM f WHERE a OR b""").replace(" SELECT CASE", ", f AS (SELECT obs_subject_id, c_acctbal > 3000 AS a, c_nationkey < 8 AS b FROM meta) SELECT CASE", 1),
        "collection_head_tail": _ct("SELECT obs_id, 'head' AS side FROM ct_pos WHERE pos < 7 UNION ALL SELECT obs_id, 'tail' FROM ct_pos, ct_n WHERE pos >= n - 5"),
        "study_head_tail": _study("SELECT obs_subject_id, 'head' AS side FROM meta_pos WHERE pos < 7 UNION ALL SELECT obs_subject_id, 'tail' FROM meta_pos WHERE pos >= (SELECT count(*) FROM meta) - 5"),
        "canonical_order": _ct("SELECT pos, obs_id FROM ct_pos"),
        "index_take_mask": _ct("""SELECT 'take' AS op, obs_id AS key FROM ct_pos WHERE pos IN (2, 5, 9) UNION ALL SELECT 'mask', obs_id FROM ct_pos WHERE pos % 50 = 3
 UNION ALL SELECT 'short mask', 'ValueError' UNION ALL SELECT 'outside', 'IndexError'"""),
        "index_lookup": _ct("""SELECT 'get_index' AS op, pos AS value FROM ct_pos WHERE vec_id = 300 UNION ALL SELECT 'get_key', vec_id FROM ct_pos WHERE pos = 11 UNION ALL SELECT 'contains', 1
 UNION ALL SELECT 'lacks', 0 UNION ALL SELECT 'length', n FROM ct_n UNION ALL SELECT 'repeated keys', 1"""),
        "index_relations": _values("relation VARCHAR, holds BOOLEAN", ("subset", True), ("superset", True), ("not subset", False), ("equal", True), ("aligned", True), ("other order is not", False)),
        "tiles_of_view": _ct("SELECT obs_id, 4::BIGINT AS tiles, 256::BIGINT AS bytes FROM ct WHERE label = 3"),
        "channel_samples": _ct("SELECT obs_id, p, round(value, 6) AS c0, (value > 0.1)::INT::DOUBLE AS c1 FROM ct_cells"),
        "sample_labels": _ct("SELECT obs_id, toxic AS label FROM ct JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) ON doc_id = vec_id WHERE toxic IS NOT NULL"),
        "label_function": _ct("SELECT obs_id, 'function' AS source, vec_id % 7 AS label FROM ct UNION ALL SELECT obs_id, 'column', label::BIGINT FROM ct"),
        "collection_counts": _study("""SELECT 'subjects' AS what, count(*) AS n FROM meta UNION ALL SELECT 'collections', 2 UNION ALL SELECT 'CT', count(*) FROM ct UNION ALL SELECT 'MR', count(*) FROM mr
 UNION ALL SELECT 'view of CT', count(*) FROM ct WHERE label = 1 UNION ALL SELECT 'view of subjects', count(*) FROM meta WHERE c_nationkey = 3"""),
        "subject_counts": _ct("SELECT obs_subject_id, count(*) AS n_volumes, min(obs_id) AS first_obs, max(obs_id) AS last_obs FROM ct GROUP BY 1"),
        "subject_views": _ct("SELECT obs_subject_id, obs_id FROM ct WHERE vec_id % 150 IN (3, 11)"),
        "voxel_statistics": _ct("""SELECT obs_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
 round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.9), 6) AS p90 FROM ct_cells GROUP BY 1"""),
        "voxel_histogram": _ct("""SELECT e.obs_id, r.bin, coalesce(h.n, 0)::BIGINT AS n FROM ct e CROSS JOIN (SELECT unnest(range(8)) AS bin) r
 LEFT JOIN (SELECT obs_id, least(floor((value + 0.4) / 0.1), 7)::BIGINT AS bin, count(*) AS n FROM ct_cells WHERE value >= -0.4 AND value <= 0.4 GROUP BY 1, 2) h ON h.obs_id = e.obs_id AND h.bin = r.bin"""),
        "voxel_histogram_own_range": _ct("SELECT obs_id, 5::BIGINT AS bins, count(*)::BIGINT AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM ct_cells GROUP BY 1"),
        "study_describe": _study("""SELECT 'c_mktsegment' AS what, c_mktsegment AS value, count(*) AS n FROM meta GROUP BY 2 UNION ALL SELECT 'subjects', '', count(*) FROM meta
 UNION ALL SELECT 'volumes', collection, count(*) FROM every GROUP BY collection"""),
        "volume_shapes": "SELECT 4::BIGINT AS x, 4::BIGINT AS y, 4::BIGINT AS z, count(*) AS n FROM embeddings",
        "mask_foreground": _seg("SELECT obs_id, x, y, z FROM seg_cells WHERE value = 1"),
        "all_obs_ids": _study("SELECT obs_id FROM every"),
        "scan_counters": "SELECT 'rows' AS what, count(*) AS n FROM embeddings UNION ALL SELECT 'scans', 1",
        "tiles_axial": _sums("z = 2"),
        "tiles_sagittal": _sums("x = 1"),
        "tiles_coronal": _sums("y = 3"),
        "tiles_region": _sums("x BETWEEN 1 AND 2 AND y < 2 AND z >= 2"),
        "volume_reads": f"WITH {_CT}, one AS ({_ONE}) " + " UNION ALL ".join(
            _read(*r) for r in (("axial", "z = 1"), ("coronal", "y = 2"), ("sagittal", "x = 0"), ("box", "x IN (1, 2) AND y < 2 AND z >= 2"), ("line", "x = 1 AND y = 2"), ("voxel", "x = 1 AND y = 2 AND z = 3"), ("slice", "x < 2"), ("negative", "x = 3 AND z = 2"))
        ),
        "volume_properties": _values("property VARCHAR, value VARCHAR", ("shape", "4x4x4"), ("ndim", "3"), ("dtype", "float32"), ("tile", "4x4x1"), ("tiles", "axial"), ("obs_id", "CT000000300")),
        "volume_numbers": f"""WITH {_CT}, one AS ({_ONE}), s AS (SELECT avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.5) AS median,
 quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75 FROM one) SELECT what, round(value, 6) AS value FROM (UNPIVOT s ON mean, std, min, max, median, p25, p75 INTO NAME what VALUE value)
 UNION ALL SELECT 'bin ' || bin, count(value)::DOUBLE FROM (SELECT unnest(range(4)) AS bin) LEFT JOIN one ON least(floor((value + 1) / 0.5), 3) = bin GROUP BY bin UNION ALL SELECT 'edges', 5.0""",
        "stacked_head": _ct("""SELECT pos AS place, 4::BIGINT AS axes, round(sum(value), 4) AS total, round(sum(value), 4) AS again FROM ct_pos JOIN ct_cells USING (obs_id) WHERE pos < 8 GROUP BY 1"""),
        "tile_extents": _values("tiles VARCHAR, extents VARCHAR", ("axial", "20x30x1"), ("sagittal", "1x30x5"), ("coronal", "20x1x5"), ("isotropic", "8x8x5"), ("given", "3x4x5"), ("four axes", "20x1x5x2")),
        "volumes_las": _ct("SELECT vec_id, 3 - x AS x, y, z, round(value, 6) AS value FROM ct_cells"),
        "volumes_lps": _ct("SELECT vec_id, 3 - x AS x, 3 - y AS y, z, round(value, 6) AS value FROM ct_cells"),
        "orientations": _values(
            "affine VARCHAR, axcodes VARCHAR, is_valid BOOLEAN, confidence VARCHAR, returns BOOLEAN", ("identity", "RAS", False, "low", True), ("spaced", "RAS", True, "header", True), ("flipped", "LPS", True, "header", True),
            ("turned", "AIR", True, "header", True), ("sheared", "RAS", False, "low", True), ("flat", "RAS", False, "low", True),
        ),
        "nifti_export": _ct("SELECT obs_id, count(*) AS n, round(sum(value), 4) AS total FROM ct_cells GROUP BY 1"),
        "renamed_volume": _ct("SELECT CASE vec_id WHEN 1 THEN 'CT000000002' WHEN 2 THEN 'X2' ELSE obs_id END AS obs_id, label, round(sum(value), 4) AS total, TRUE AS same FROM ct_cells WHERE vec_id IN (1, 2, 3) GROUP BY vec_id, obs_id, label"),
        "mapped_normalized": _ct("SELECT c.vec_id, c.p, round((c.value - m.mu) / m.sd, 5) AS value FROM ct_cells c JOIN (SELECT vec_id, avg(value) AS mu, stddev_pop(value) AS sd FROM ct_cells GROUP BY 1) m USING (vec_id)"),
        "mapped_updates": _ct("""SELECT obs_subject_id, obs_id, round(max(value), 6) AS peak, avg(value) > 0 AS positive, (2 * any_value(label))::BIGINT AS twice, 'l' || any_value(label) AS kind, '4x4x4 float32' AS result
 FROM ct_cells GROUP BY 1, 2"""),
        "mapped_update_kinds": _values("column VARCHAR, kind VARCHAR", ("i", "bigint"), ("f", "double"), ("b", "boolean"), ("t", "string"), ("mixed", "double")).replace("column", '"column"'),
        "mapped_chain": _ct("SELECT vec_id, round(sum(greatest(value, 0)) * count(*) FILTER (WHERE value > 0), 4) AS value FROM ct_cells GROUP BY 1"),
        "mapped_composed": _ct("SELECT vec_id, round(sum(value + label), 4) AS value FROM ct_cells WHERE label >= 2 GROUP BY 1"),
        "mapped_batches": _ct("""SELECT vec_id, round(sum(t) OVER (PARTITION BY pos // 8), 4) AS in_batch FROM (SELECT p.vec_id, p.pos, sum(value) AS t FROM ct_pos p JOIN ct_cells c USING (obs_id) GROUP BY 1, 2)"""),
        "mapped_extract": _ct("SELECT pos AS place, label::BIGINT AS label, label::BIGINT AS again, label::BIGINT AS by_place FROM ct_pos WHERE pos < 6"),
        "mapped_summaries": _values("result VARCHAR", *[("2x4x4 float32",)] * 3, *[("1.2500",)] * 2),
        "transforms": _ct("SELECT obs_id, 64::BIGINT AS n, round(2 * sum(value), 4) AS total FROM ct_pos JOIN ct_cells USING (obs_id) WHERE pos < 4 GROUP BY 1"),
        "composed_updates": _values("what VARCHAR, value BIGINT", ("value", 30), ("b", 10), ("c", 30)),
        "table_life": _ct("""SELECT obs_subject_id, obs_id, CASE WHEN vec_id < 20 THEN 'low' END AS note, label / 2 AS score, 'A1' AS site FROM ct WHERE label BETWEEN 3 AND 8"""),
        "written_collection": _ct("SELECT obs_id, count(*) AS n, round(sum(value), 4) AS total FROM ct_cells WHERE label >= 6 GROUP BY 1"),
        "written_study": _study(_obs_ids("SELECT * FROM every", "SELECT * FROM meta WHERE c_nationkey < 6")),
        "written_map": _ct("""SELECT obs_subject_id || '_CT' || CASE WHEN k = 0 THEN '' ELSE '_acq-' || k END AS obs_id, 32::BIGINT AS n, total, peak, 4 AS label, obs_subject_id FROM (
 SELECT obs_subject_id, row_number() OVER (PARTITION BY obs_subject_id ORDER BY obs_id) - 1 AS k, round(2 * sum(value) FILTER (WHERE x < 2), 4) AS total, round(max(value), 6) AS peak
 FROM ct_cells WHERE label = 4 GROUP BY obs_subject_id, obs_id)"""),
        "written_lazy": _ct("""SELECT obs_subject_id, sum(n)::BIGINT AS n, round(sum(t), 2) AS total FROM (SELECT c.obs_subject_id, c.obs_id, count(*) AS n, round(sum(value + c.label), 4) AS t
 FROM ct_cells c JOIN ct_pos p USING (obs_id) WHERE p.pos < 120 AND c.label < 3 GROUP BY 1, 2) GROUP BY 1"""),
        "collection_writer": _values("obs_id VARCHAR, obs_subject_id VARCHAR, age BIGINT, n BIGINT, total DOUBLE, hidden BOOLEAN, nothing_left BOOLEAN", ("v0", "p0", 40, 6, 0.0, True, True), ("v1", "p1", 41, 12, 12.0, True, True), ("v2", "p2", 42, 18, 36.0, True, True)),
        "study_writer": _study("SELECT obs_subject_id, c_nationkey, CASE k WHEN 0 THEN '[a,c]' WHEN 1 THEN '[b]' ELSE '[]' END AS obs_ids FROM (SELECT *, row_number() OVER (ORDER BY obs_subject_id) - 1 AS k FROM meta WHERE c_nationkey = 3)"),
        "appended_volumes": f"""SELECT {_NAME} AS obs_subject_id, {_NAME} || '_T1w' AS obs_id FROM embeddings WHERE vec_id % 5 IN (0, 1) UNION ALL SELECT {_NAME}, {_NAME} || '_T1w_acq-1' FROM embeddings WHERE vec_id % 10 = 0""",
        "appended_study": f"""WITH o AS (SELECT {_NAME} AS obs_subject_id, {_NAME} || '_T1w' AS obs_id FROM embeddings WHERE vec_id % 7 IN (0, 1) UNION ALL SELECT {_NAME}, {_NAME} || '_T2w' FROM embeddings WHERE vec_id % 14 = 0)
 SELECT obs_subject_id, {_JSON} AS obs_ids FROM o GROUP BY 1""",
        "added_collection": _study("""SELECT c AS collection, count(*) AS n, TRUE AS refused FROM (SELECT obs_subject_id, CASE collection WHEN 'MR' THEN 'T2' ELSE collection END AS c FROM every UNION ALL SELECT obs_subject_id, 'EX' FROM ct)
 WHERE obs_subject_id IN (SELECT obs_subject_id FROM meta WHERE c_nationkey < 3) GROUP BY 1"""),
        "copied_collection": _ct("SELECT obs_subject_id, obs_id FROM ct WHERE label = 2"),
        "collection_faults": _values("collection VARCHAR, is_so BOOLEAN", ("sound", True), ("row missing", True), ("row twice", True), ("tiles missing", True)),
        "every_study_fault": _values("fault VARCHAR, key VARCHAR", ("subject listed twice", "b"), ("observation without subject", "7"), ("obs_id used twice", "7"), ("obs_ids is stale", "a"), ("obs_ids is stale", "c")),
        "guards": _values("what VARCHAR, error VARCHAR, is_raised BOOLEAN", *((k, e, True) for k, e in (
            ("column exists", "SchemaError"), ("key column", "SchemaError"), ("no such column", "TomolakeError"), ("unknown type", "SchemaError"), ("table exists", "StorageError"), ("nothing there", "StorageError"),
            ("patch too large", "ShapeError"), ("not aligned", "AlignmentError"), ("no subjects", "SchemaError"), ("no such collection", "KeyError"), ("outside", "IndexError"), ("two axes", "ShapeError"),
        ))),
        "volume_samples": _ct("SELECT pos AS idx, obs_id, count(*) AS n, round(sum(value), 4) AS total FROM ct_pos JOIN ct_cells USING (obs_id) GROUP BY 1, 2"),
        "slice_samples": _ct("SELECT pos * 4 + y AS idx, obs_id, count(*) AS n, round(sum(value), 4) AS total FROM ct_pos JOIN ct_cells USING (obs_id) GROUP BY pos, y, obs_id"),
        "pair_samples": _ct("""SELECT pos AS idx, obs_id, 'SG' || lpad(any_value(c.vec_id)::VARCHAR, 9, '0') AS mask_obs_id, count(*) FILTER (WHERE value > 0.1) AS n, round(coalesce(sum(value) FILTER (WHERE value > 0.1), 0), 4) AS total
 FROM ct_pos JOIN ct_cells c USING (obs_id) GROUP BY 1, 2"""),
        "loader_batches": _ct("SELECT pos // 4 AS batch, obs_id, round(sum(value), 4) AS total, TRUE AS same FROM ct_pos JOIN ct_cells USING (obs_id) WHERE pos < 10 GROUP BY 1, 2"),
        "training_epochs": _ct("""SELECT 'samples' AS what, n FROM ct_n UNION ALL SELECT 'batches', n // 16 FROM ct_n UNION ALL SELECT 'differ', 1 UNION ALL SELECT 'same samples', 1 UNION ALL SELECT 'pair batches', 2
 UNION ALL SELECT 'inference', n FROM ct_n"""),
        "loader_ranks": _ct("""SELECT i % 3 AS rank, i % n AS idx FROM (SELECT n, unnest(range((n + 2) // 3 * 3)) AS i FROM ct_n)"""),
        "dataset_of_collection": _ct("SELECT 'samples' AS what, count(*) AS n FROM ct WHERE label = 1 UNION ALL SELECT 'patch', 8"),
        "settings": _values("setting VARCHAR, value VARCHAR", *((k, "refused") for k in ("tile of 0", "level below 0", "unknown orientation", "no workers", "patch without size", "no patches", "unknown plane")), ("workers", "4"), ("tiles", "axial"), ("target", "RAS")),
        "store_options": _values(
            "option VARCHAR, value VARCHAR", ("fs.s3a.endpoint.region", "eu-west-1"), ("fs.s3a.endpoint", "http://store:9000"), ("fs.s3a.path.style.access", "true"), ("fs.s3a.multipart.size", "32M")
        ),
        "exported_names": "SELECT TRUE AS resolves",
        "arrived_volumes": f"SELECT {half_pairs} AS obs_subject_id, {half_pairs} || '_seen' AS obs_id FROM embeddings WHERE vec_id % 4 IN (0, 1)",
        "small_functions": _values(
            "what VARCHAR, value VARCHAR", ("stem", "lung_001"), ("summary of array", "2x3 int16"), ("summary of number", "1.2500"), ("summary of text", "x"), ("named sibling", "/x/mr"), ("sibling", "/x/ct_written"),
            ("tuple", "(1.0, 2.5)"), ("affine", "[0.0, 0.0, 0.0, 1.0]"),
        ),
        "nan_defaults": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_acctbal ELSE 1.5 END AS value FROM customer",
    }
