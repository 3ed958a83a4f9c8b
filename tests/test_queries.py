"""A part of the registered queries against DuckDB; the driver compares all of them."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "px_add", "px_broadcast", "px_select", "proj_percentile_75", "proj_posmax", "radial_mean", "stat_quartiles", "stat_spearman", "cumsum_integral", "err_psnr", "ovl_overlap",
    "hist_2d_mutualinfo", "thr_otsu", "lut_equalize", "flt_gauss_fir", "flt_median3", "mor_open_rect", "bin_fillholes", "lab_label4_distributed", "lab_rag", "edt_sq", "msr_core",
    "msr_merge", "msr_otsu_objects", "geo_extend", "tns_eig2x2", "mic_manders", "gra_components", "dst_chordlength", "evt_window",
    "flt_laplace", "var_semivariogram", "dst_pair_correlation", "bin_open", "ovl_hausdorff", "col_rgb2lab", "col_luv_and_back", "tns_det2", "msr_shape", "px_pad",
    "thr_isodata", "thr_minerror", "thr_triangle", "thr_background", "flt_bilateral", "flt_perona_malik", "flt_kuwahara", "gra_msf",
    "hist_marginal_median", "tns_expand_singleton", "tns_reshape", "ctr_chain_to_eight", "ctr_chain_feret", "ctr_polygon_contains",
    "flt_dgg", "flt_general", "flt_convolve_ft", "mor_lee", "mor_reconstruction", "mor_impose_minima", "mor_maxima", "thr_hysteresis", "bin_isotropic_closing", "bin_union_sup_generating",
    "geo_resampling_cubic", "geo_affine", "geo_resample_at", "geo_split_dimension", "ft_spectrum", "ft_haar", "hist_regression", "dst_differentiate", "dst_set_sampling", "typ_clamp_cast",
    "stat_ssim", "stat_noise_variance", "gra_union_find", "gra_connected_to", "lab_map_xor", "lab_apply_map_to_measurement", "tns_singular_values", "gen_gabor", "px_apply_lut_linear", "msr_grey", "tile_gauss", "tile_opening", "msr_feret", "msr_perimeter", "msr_greymajoraxes", "mor_area_opening", "mor_directed_path_opening", "io_png", "io_ics", "io_information_tiff",
]


def rounded(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr([rounded(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(repr([rounded(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert mine == theirs


def against_sql(spark, name, folder):
    """Rows of a query over the tables of a folder, and those of its SQL."""
    import duckdb

    df = entry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    theirs = c.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(repr([rounded(r[k]) for k in columns]) for r in df.collect()), sorted(repr([rounded(v) for v in r]) for r in theirs)


def test_suppliers_at_one_place(spark, duck, tmp_path):
    # positions repeat after 38430 keys
    duck.execute(f"COPY (SELECT * REPLACE (s_suppkey % 5 * 38430 + s_suppkey // 5 AS s_suppkey) FROM supplier) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    os.symlink(f"{SF}/lineitem.parquet", tmp_path / "lineitem.parquet")
    mine, theirs = against_sql(spark, "geo_resample_at", tmp_path)
    assert len(mine) == 10 and mine == theirs


@pytest.mark.parametrize("change, where", [("event_id * 3000000000000000 - 7 AS event_id", "true"), ("CASE WHEN event_id % 9 > 2 THEN value END AS value", "true"), ("80.0 AS value", "true"), ("value", "false")])
def test_chords_of_odd_events(spark, duck, tmp_path, change, where):
    replaced = f"REPLACE ({change})" if " AS " in change else ""
    duck.execute(f"COPY (SELECT * {replaced} FROM events WHERE {where}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    mine, theirs = against_sql(spark, "dst_chordlength", tmp_path)
    assert mine == theirs


def test_chords_of_many_events_share_no_task(spark, duck, tmp_path):
    duck.execute(f"COPY (SELECT * REPLACE (event_id + 1000 * i AS event_id) FROM events, (SELECT unnest(range(20)) AS i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    mine, theirs = against_sql(spark, "dst_chordlength", tmp_path)
    assert mine == theirs
    plan = entry.queries()["dst_chordlength"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(part" in plan


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
