"""DuckDB SQL for the queries: the fixtures as common table expressions, and a statement for each key."""

from __future__ import annotations

EX = "ex AS (SELECT vec_id, i - 1 AS pos, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i))"
SAMPLES = """samples AS (SELECT concat('s', vec_id) AS sampleid,
  CASE WHEN vec_id % 10 <> 0 THEN 25 + 60 * embedding[1]::DOUBLE END AS x, CASE WHEN vec_id % 10 <> 0 THEN 25 + 60 * embedding[2]::DOUBLE END AS y FROM embeddings)"""


def wide(a0: str, a1: str) -> str:
    """The calls of all pairs of components, given the rules for both alleles."""
    return f"""raw AS (SELECT vec_id, i * 64 + j AS k, embedding[i + 1]::DOUBLE * embedding[j + 1]::DOUBLE * 8 AS v FROM embeddings, range(0, 64) a(i), range(0, 64) b(j) WHERE i <= j),
calls AS (SELECT concat('s', vec_id) AS sampleid, '1' AS chrom, ((k + 1) * 1000)::BIGINT AS position, {a0} AS a0, {a1} AS a1
  FROM (SELECT *, substr(md5(concat('miss|', vec_id, '|', k)), 1, 2) = '00' AS m, substr(md5(concat('half|', vec_id, '|', k)), 1, 2) = '00' AS f FROM raw)),
dos AS (SELECT sampleid, chrom, position, a0, a1, a0 < 0 OR a1 < 0 AS gone, (a0 = 1)::INT + (a1 = 1)::INT AS dosage FROM calls)"""


A0 = "WHEN k % 13 = 0 THEN 0 WHEN v > 1e-1 THEN CASE WHEN k % 17 = 0 AND v > 2e-1 THEN 2 ELSE 1 END ELSE 0 END"
A1 = "WHEN k % 13 = 0 THEN 0 WHEN v > 2e-2 THEN 1 ELSE 0 END"
WIDE = wide(f"CASE WHEN m THEN -1 {A0}", f"CASE WHEN m THEN -1 {A1}")
MANY = (
    wide(f"CASE WHEN m THEN -1 WHEN k % 19 = 0 AND v > 15e-2 THEN CASE WHEN k % 38 = 0 THEN 200 ELSE (3 + k % 3)::INT END {A0}", f"CASE WHEN m OR f THEN -1 {A1}")
    + """, seen AS (SELECT chrom, position, unnest([a0, a1]) AS a FROM calls),
counts AS (SELECT chrom, position, count(*) FILTER (a = 0) AS n0, count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 2) AS n2, count(*) FILTER (a = 3) AS n3,
  count(DISTINCT a) FILTER (a > 3) AS others, count(DISTINCT a) FILTER (a >= 0) AS alleles FROM seen GROUP BY ALL)"""
)
CLINE = (
    EX
    + """, calls AS (SELECT concat('s', vec_id) AS sampleid, '1' AS chrom, ((pos * 8 + t + 1) * 1000)::BIGINT AS position,
  (v > (t - 4) * 4e-2)::INT AS a0, (v > (t - 4) * 4e-2 + 5e-2)::INT AS a1 FROM ex, range(0, 8) q(t)),
dos AS (SELECT sampleid, chrom, position, a0 + a1 AS dosage FROM calls)"""
)


def md5(seed, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def u(seed, *keys: str) -> str:
    return f"(('0x' || substr({md5(seed, *keys)}, 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE)"


def binomial2(p: str, seed, *keys: str) -> str:
    return f"(({u(f'{seed}/0', *keys)} < {p})::INT + ({u(f'{seed}/1', *keys)} < {p})::INT)"


PRED = f"""{SAMPLES}, known AS (SELECT * FROM samples WHERE x IS NOT NULL),
pred AS (SELECT sampleid, r AS replicate, x + 4 * ({u(7, 'r', 'sampleid')} - 5e-1) AS x, y + 4 * ({u(8, 'r', 'sampleid')} - 5e-1) AS y FROM known, range(0, 10) q(r))"""
ERRORS = f"{PRED}, err AS (SELECT p.*, s.x AS x_true, s.y AS y_true, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS err FROM pred p JOIN known s USING (sampleid))"
FREQ = "freq AS (SELECT chrom, position, sum(dosage)::BIGINT AS n1, count(*) FILTER (NOT gone) AS called FROM dos GROUP BY ALL)"
SITES = "sites AS (SELECT DISTINCT chrom, position FROM calls), indexed AS (SELECT *, row_number() OVER (ORDER BY chrom, position) - 1 AS site FROM sites)"
CHROM = "CASE WHEN position // 1000 % 3 = 0 THEN '2' ELSE chrom END"
ROLES = f"""ranked AS (SELECT sampleid, row_number() OVER (ORDER BY {md5(0, 'sampleid')}, sampleid) - 1 AS r, count(*) OVER () AS n FROM samples WHERE x IS NOT NULL),
roles AS (SELECT sampleid, CASE WHEN r < round_even((1 - 9e-1) * n, 0) THEN 'val' ELSE 'train' END AS role FROM ranked UNION ALL SELECT sampleid, 'pred' FROM samples WHERE x IS NULL)"""
RINGS = """box AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, (min(x) + max(x)) / 2 mx, (min(y) + max(y)) / 2 my FROM samples),
rings AS (SELECT 0 AS poly, ring, seq, CASE WHEN ring = 0 THEN CASE WHEN seq IN (1, 2) THEN x1 ELSE x0 END ELSE CASE WHEN seq IN (1, 2) THEN mx + (x1 - x0) / 8 ELSE mx - (x1 - x0) / 8 END END AS x,
  CASE WHEN ring = 0 THEN CASE WHEN seq >= 2 THEN y1 ELSE y0 END ELSE CASE WHEN seq >= 2 THEN my + (y1 - y0) / 8 ELSE my - (y1 - y0) / 8 END END AS y FROM box, range(0, 2) a(ring), range(0, 4) b(seq)),
edges AS (SELECT poly, ring, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM rings WINDOW w AS (PARTITION BY poly, ring ORDER BY seq))"""
RES = "4e0"
MASK = f"""{RINGS}, cells AS (SELECT r AS "row", c AS col, x0 + (c + 5e-1) * {RES} AS px, y1 - (r + 5e-1) * {RES} AS py FROM box, range(0, 1000) a(r), range(0, 1000) b(c)
  WHERE r < trunc((y1 - y0) / {RES})::INT AND c < trunc((x1 - x0) / {RES})::INT),
mask AS (SELECT "row", col, (count(e.x) % 2)::DOUBLE AS valid FROM cells LEFT JOIN edges e ON e.y <> e.y2 AND (e.y > py) <> (e.y2 > py) AND px < (e.x2 - e.x) * (py - e.y) / (e.y2 - e.y) + e.x GROUP BY ALL)"""
LOOKUP = f"""{MASK}, looked AS (SELECT sampleid, s.x, s.y,
  greatest(0, least(round_even((y1 - s.y) / {RES}, 0)::INT, trunc((y1 - y0) / {RES})::INT - 1)) AS "row", greatest(0, least(round_even((s.x - x0) / {RES}, 0)::INT, trunc((x1 - x0) / {RES})::INT - 1)) AS col
  FROM samples s, box WHERE s.x IS NOT NULL), valued AS (SELECT looked.*, valid FROM looked JOIN mask USING ("row", col))"""
BIN = lambda x, lo, hi, n: f"greatest(0, least(CASE WHEN {hi} = {lo} THEN 0 ELSE ceil(({x} - {lo}) / (({hi} - {lo}) / {n}))::INT - 1 END, {n - 1}))"
EXTENT = "ext AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM known)"
KNOWN = "known AS (SELECT * FROM samples WHERE x IS NOT NULL)"
HIST = f"""{SAMPLES}, {KNOWN}, {EXTENT}, binned AS (SELECT sampleid, {BIN('x', 'x0', 'x1', 10)} AS xbin, {BIN('y', 'y0', 'y1', 10)} AS ybin FROM known, ext),
h AS (SELECT xbin, ybin, count(*) AS n FROM binned GROUP BY ALL)"""
PAIRS = f"{SAMPLES}, {KNOWN}, pairs AS (SELECT a.sampleid, b.sampleid AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM known a, known b)"
WEIGHTS = "wts AS (SELECT concat('s', vec_id % 400) AS sampleid, (vec_id % 7 + 1) * 25e-2 AS sample_weight, vec_id AS ord FROM embeddings)"
MOMENTS = "m AS (SELECT avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy FROM samples)"
SURFACE = f"""{PRED}, box AS (SELECT min(x) - 1e-1 * (max(x) - min(x)) xmin, max(x) + 1e-1 * (max(x) - min(x)) xmax, min(y) - 1e-1 * (max(y) - min(y)) ymin, max(y) + 1e-1 * (max(y) - min(y)) ymax FROM pred),
st AS (SELECT sampleid, count(*) n, var_samp(x) vx, var_samp(y) vy, covar_samp(x, y) vxy, pow(count(*), -1e0 / 3) h FROM pred GROUP BY ALL),
cells AS (SELECT st.*, vx * vy - vxy * vxy det, xmin + i * ((xmax - xmin) / 99) gx, ymin + j * ((ymax - ymin) / 99) gy FROM st, box, range(0, 100) a(i), range(0, 100) b(j)),
surf AS (SELECT c.sampleid, gx, gy, sum(exp(-5e-1 * (vy * (gx - p.x) * (gx - p.x) - 2 * vxy * (gx - p.x) * (gy - p.y) + vx * (gy - p.y) * (gy - p.y)) / det / h)) / any_value(c.n) / any_value(2 * pi() * sqrt(det) * h) AS density
  FROM cells c JOIN pred p USING (sampleid) GROUP BY c.sampleid, gx, gy)"""
HDR = f"""{SURFACE}, grids AS (SELECT sampleid, (max(gx) - min(gx)) / (count(DISTINCT gx) - 1) * ((max(gy) - min(gy)) / (count(DISTINCT gy) - 1)) AS area FROM surf GROUP BY ALL),
rising AS (SELECT *, sum(density) OVER (PARTITION BY sampleid ORDER BY density, gx, gy ROWS UNBOUNDED PRECEDING) * area AS m1 FROM surf JOIN grids USING (sampleid)),
steps AS (SELECT *, lag(m1) OVER w AS m0, lag(density) OVER w AS d0 FROM rising WINDOW w AS (PARTITION BY sampleid ORDER BY density, gx, gy)),
want AS (SELECT sampleid, mass::DOUBLE AS mass, 1 - mass::DOUBLE AS t FROM grids, (VALUES (95e-2), (5e-1), (1e-1)) v(mass))"""
PEAK = f"""{PRED}, st AS (SELECT sampleid, list(x ORDER BY x, y) xs, list(y ORDER BY x, y) ys, min(x) x0, max(x) x1, min(y) y0, max(y) y1,
  106e-2 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 134e-2) * pow(count(*), -2e-1) hx,
  106e-2 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 134e-2) * pow(count(*), -2e-1) hy FROM pred GROUP BY ALL),
kx AS (SELECT sampleid, x0 + i * ((x1 - x0) / 499) AS gx, list_transform(xs, lambda p: exp(-5e-1 * pow((gx - p) / hx, 2))) AS k FROM st, range(0, 500) a(i)),
ky AS (SELECT sampleid, y0 + i * ((y1 - y0) / 499) AS gy, list_transform(ys, lambda p: exp(-5e-1 * pow((gy - p) / hy, 2))) AS k FROM st, range(0, 500) a(i)),
peaks AS (SELECT kx.sampleid, min(struct_pack(d := -round(list_inner_product(kx.k, ky.k), 9), gx := gx, gy := gy)) AS b FROM kx JOIN ky USING (sampleid) GROUP BY ALL)"""
SCORES = f"""{SAMPLES}, {KNOWN}, rk AS (SELECT *, row_number() OVER (ORDER BY sampleid) - 1 AS r, count(*) OVER () AS n FROM known),
fd AS (SELECT *, CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1) ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM rk),
p AS (SELECT a.sampleid, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM fd a JOIN fd b ON a.fold <> b.fold),
g AS (SELECT 1e-1 + k * ((10 - 1e-1) / 999) AS bandwidth FROM range(0, 1000) t(k)),
near AS (SELECT *, min(d2) OVER (PARTITION BY sampleid) AS d0 FROM p),
ld AS (SELECT sampleid, bandwidth, ln(sum(exp((d0 - d2) / (2 * bandwidth * bandwidth))) / (count(*) * 2 * pi() * bandwidth * bandwidth)) - any_value(d0) / (2 * bandwidth * bandwidth) AS v FROM near, g GROUP BY sampleid, bandwidth),
scores AS (SELECT bandwidth, sum(v) AS score FROM ld GROUP BY ALL)"""
CIRCLE = """geo AS (SELECT vec_id, 180 * embedding[1]::DOUBLE AS lon1, 90 * embedding[2]::DOUBLE AS lat1, 180 * embedding[3]::DOUBLE AS lon2, 90 * embedding[4]::DOUBLE AS lat2 FROM embeddings),
g1 AS (SELECT *, radians((lat1 + lat2) / 2) f, radians((lat1 - lat2) / 2) g, radians((lon1 - lon2) / 2) l FROM geo),
g2 AS (SELECT *, sin(g) ** 2 * cos(l) ** 2 + cos(f) ** 2 * sin(l) ** 2 AS s, cos(g) ** 2 * cos(l) ** 2 + sin(f) ** 2 * sin(l) ** 2 AS c FROM g1),
g3 AS (SELECT *, atan(sqrt(s / c)) w, sqrt(s * c) / atan(sqrt(s / c)) r FROM g2),
circle AS (SELECT vec_id, CASE WHEN lon1 = lon2 AND lat1 = lat2 THEN 0 ELSE 2 * w * 6378.137::DOUBLE * (1 + (1 / 298.257223563::DOUBLE) * ((3 * r - 1) / (2 * c) * sin(f) ** 2 * cos(g) ** 2 - (3 * r + 1) / (2 * s) * cos(f) ** 2 * sin(g) ** 2)) END AS km FROM g3)"""
JACK = f"""{CLINE}, {SITES}, jr AS (SELECT r AS replicate, chrom, position, row_number() OVER (PARTITION BY r ORDER BY {md5(0, 'r', 'chrom', 'position')}, chrom, position) AS k FROM sites, range(0, 5) q(r)),
masked AS (SELECT replicate, chrom, position FROM jr WHERE k <= floor((SELECT count(*) FROM sites) * 5e-2)),
freq AS (SELECT chrom, position, sum(dosage)::DOUBLE / (2 * count(*)) AS freq FROM dos GROUP BY ALL)"""


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


R = lambda c, name=None: f"round({c}, 6) AS {name or c}"

ORACLE = {
    "scan_vcf": q(MANY, f"SELECT sampleid, {CHROM} AS chrom, position, a0, a1 FROM calls"),
    "scan_vcf_region": q(
        MANY, f"SELECT * FROM (SELECT sampleid, {CHROM} AS chrom, position, a0, a1 FROM calls) WHERE chrom = '2' AND position >= 500000 AND position < 1500000"
    ),
    "scan_matrix": q(CLINE, "SELECT sampleid, chrom, position, (dosage >= 1)::INT AS a0, (dosage = 2)::INT AS a1 FROM dos"),
    "scan_genotype_frame": q(CLINE, "SELECT sampleid, chrom, position, (dosage >= 1)::INT AS a0, (dosage = 2)::INT AS a1 FROM dos"),
    "genotype_lake": q(WIDE, "SELECT sampleid, chrom, position, a0, a1 FROM calls WHERE position >= 500000 AND position < 1500000"),
    "scan_sample_data": q(SAMPLES, "SELECT sampleid, x, y FROM samples"),
    "scan_sample_weights": q(WEIGHTS, "SELECT sampleid, sample_weight FROM wts"),
    "scan_predictions": q(PRED, f"SELECT 'run_bootstrap_predlocs.csv' AS run, sampleid, {R('x')}, {R('y')} FROM pred"),
    "scan_range_polygon": q(f"{SAMPLES}, {RINGS}", f"SELECT poly, ring, {R('x')}, {R('y')}, {R('x2')}, {R('y2')} FROM edges"),
    "sink_predictions": q(PRED, f"SELECT sampleid, replicate, {R('x')}, {R('y')} FROM pred"),
    "alleles_from_dosage": q(WIDE, "SELECT sampleid, position, (dosage >= 1)::INT AS b0, (dosage = 2)::INT AS b1 FROM dos"),
    "dosage_from_alleles": q(WIDE, "SELECT sampleid, position, dosage FROM dos"),
    "is_missing_call": q(WIDE, "SELECT sampleid, position, gone FROM dos"),
    "validate_dosage": q(WIDE, "SELECT sampleid, position, a0 + a1 AS dosage FROM calls WHERE a0 + a1 NOT IN (0, 1, 2)"),
    "known_filter": q(SAMPLES, "SELECT sampleid, x, y FROM samples WHERE x IS NOT NULL"),
    "unknown_filter": q(SAMPLES, "SELECT sampleid FROM samples WHERE x IS NULL"),
    "position_range_filter": q(WIDE, "SELECT sampleid, position, dosage FROM dos WHERE position >= 250000 AND position < 750000"),
    "normalize_coords": q(f"{SAMPLES}, {MOMENTS}", f"SELECT sampleid, {R('(x - mx) / sx', 'x')}, {R('(y - my) / sy', 'y')} FROM samples, m"),
    "denormalize_coords": q(SAMPLES, f"SELECT sampleid, {R('x')}, {R('y')} FROM samples"),
    "haplotype_explode": q(WIDE, "SELECT concat(sampleid, '_h', h) AS sampleid, position, CASE WHEN h = 0 THEN a0 ELSE a1 END AS allele FROM calls, range(0, 2) q(h)"),
    "flip_augment": q(CLINE, f"SELECT sampleid, position, CASE WHEN {u(0, '0', 'sampleid', 'chrom', 'position')} < 5e-2 THEN 1 - dosage ELSE dosage END AS dosage FROM dos"),
    "clean_sample_ids": q(SAMPLES, "SELECT sampleid FROM samples"),
    "map_extent": q(
        SAMPLES,
        "SELECT round(min(x) - 1e-1 * (max(x) - min(x)), 6) AS xmin, round(max(x) + 1e-1 * (max(x) - min(x)), 6) AS xmax, round(min(y) - 1e-1 * (max(y) - min(y)), 6) AS ymin, round(max(y) + 1e-1 * (max(y) - min(y)), 6) AS ymax FROM samples",
    ),
    "join_samples": q(f"{CLINE}, {SAMPLES}", "SELECT sampleid, position, dosage, x, y FROM dos JOIN samples USING (sampleid)"),
    "check_sample_alignment": q(f"{CLINE}, {SAMPLES}", "SELECT DISTINCT sampleid FROM dos WHERE sampleid NOT IN (SELECT sampleid FROM samples WHERE x IS NOT NULL)"),
    "join_predictions_truth": q(ERRORS, f"SELECT sampleid, replicate, {R('x')}, {R('y')}, {R('x_true')}, {R('y_true')} FROM err"),
    "training_locations": q(PRED, "SELECT sampleid FROM samples WHERE sampleid NOT IN (SELECT sampleid FROM pred)"),
    "join_weights": q(
        f"{SAMPLES}, {WEIGHTS}", "SELECT sampleid, arg_min(sample_weight, ord) AS sample_weight FROM wts JOIN samples USING (sampleid) WHERE x IS NOT NULL GROUP BY ALL"
    ),
    "window_assign_join": q(WIDE, f"SELECT DISTINCT {CHROM} AS chrom, position, (position // 250000 * 250000)::BIGINT AS window_start FROM calls"),
    "bootstrap_site_join": q(
        f"{CLINE}, {SITES}, n AS (SELECT count(*) AS n FROM sites)",
        f"SELECT replicate, position, count(*) AS times FROM (SELECT replicate, floor({u(0, 'replicate', 'draw')} * n)::BIGINT AS site FROM n, range(0, 5) a(replicate), range(0, 512) b(draw)) JOIN indexed USING (site) GROUP BY ALL",
    ),
    "jackknife_mask_join": q(JACK, "SELECT replicate, position, count(*) AS calls FROM masked JOIN dos USING (chrom, position) GROUP BY ALL"),
    "kde_pair_join": q(PAIRS, f"SELECT sampleid, count(*) AS pairs, {R('sum(d2)', 'total')} FROM pairs GROUP BY ALL"),
    "grid_cross_join": q(SURFACE, "SELECT sampleid, count(*) AS cells FROM cells GROUP BY ALL"),
    "mask_lookup": q(f"{SAMPLES}, {LOOKUP}", 'SELECT sampleid, "row", col, valid FROM valued'),
    "location_stats_join": q(
        f"{ERRORS}, a AS (SELECT x_true, y_true, avg(err) AS e FROM err GROUP BY ALL), b AS (SELECT x, y, count(*) AS n FROM known GROUP BY ALL)",
        f"SELECT {R('x_true')}, {R('y_true')}, {R('e', 'mean_error')}, n FROM a JOIN b ON x_true = x AND y_true = y",
    ),
    "allele_counts": q(MANY, "SELECT chrom, position, n0, n1, n2, n3, others FROM counts"),
    "biallelic_filter": q(MANY, "SELECT position, n0, n1 FROM counts WHERE alleles = 2"),
    "mac_filter": q(MANY, "SELECT position, n1 FROM counts WHERE n1 >= 40"),
    "filter_snps": q(MANY, "SELECT sampleid, position, dosage FROM dos WHERE position IN (SELECT position FROM counts WHERE alleles = 2 AND n1 >= 2)"),
    "allele_freq_called": q(f"{MANY}, {FREQ}", f"SELECT position, n1, called, {R('n1::DOUBLE / (2 * called)', 'freq')} FROM freq"),
    "allele_freq_all": q(WIDE, f"SELECT position, {R('sum(dosage)::DOUBLE / (2 * count(*))', 'freq')} FROM dos GROUP BY ALL"),
    "allele_freq_train": q(
        f"{CLINE}, {SAMPLES}, {ROLES}", f"SELECT position, {R('sum(dosage)::DOUBLE / (2 * count(*))', 'freq')} FROM dos JOIN roles USING (sampleid) WHERE role = 'train' GROUP BY ALL"
    ),
    "missingness": q(WIDE, "SELECT position, count(*) FILTER (NOT gone) AS called, count(*) FILTER (gone) AS missing FROM dos GROUP BY ALL"),
    "sample_missingness": q(WIDE, "SELECT sampleid, count(*) FILTER (NOT gone) AS called, count(*) FILTER (gone) AS missing FROM dos GROUP BY ALL"),
    "coord_moments": q(SAMPLES, f"SELECT {R('avg(x)', 'mean_x')}, {R('stddev_pop(x)', 'sd_x')}, {R('avg(y)', 'mean_y')}, {R('stddev_pop(y)', 'sd_y')} FROM samples"),
    "hist2d_weights": q(HIST, f"SELECT sampleid, {R('(SELECT max(n) FROM h)::DOUBLE / n', 'sample_weight')} FROM binned JOIN h USING (xbin, ybin)"),
    "kde_weights": q(
        f"{PAIRS}, d AS (SELECT sampleid, sum(exp(-d2 / (2 * 2e0 * 2e0))) AS d FROM pairs GROUP BY ALL)", "SELECT sampleid, round(1 / d / (SELECT sum(1 / d) FROM d), 9) AS sample_weight FROM d"
    ),
    "kde_bandwidth_search": q(SCORES, f"SELECT {R('bandwidth')}, {R('score')} FROM scores"),
    "bandwidth_argmax": q(SCORES, f"SELECT {R('bandwidth')} FROM (SELECT * FROM scores ORDER BY score DESC, bandwidth LIMIT 1)"),
    "weight_samples": q(HIST, f"SELECT sampleid, {R('(SELECT max(n) FROM h)::DOUBLE / n', 'sample_weight')} FROM binned JOIN h USING (xbin, ybin)"),
    "first_weight": q(WEIGHTS, "SELECT sampleid, arg_min(sample_weight, ord) AS sample_weight FROM wts GROUP BY ALL"),
    "ensemble_mean": q(
        f"{PRED}, parts AS (SELECT sampleid, x, y, 'pred' AS role FROM pred WHERE hash(sampleid) IS NOT NULL)", f"SELECT sampleid, {R('avg(x)', 'x')}, {R('avg(y)', 'y')}, role FROM parts GROUP BY sampleid, role"
    ),
    "replicate_centroid": q(PRED, f"SELECT sampleid, {R('avg(x)', 'x')}, {R('avg(y)', 'y')}, count(*) AS n FROM pred GROUP BY ALL"),
    "kde_surface": q(SURFACE, f"SELECT sampleid, {R('gx')}, {R('gy')}, {R('density')} FROM surf"),
    "kde_contour_levels": q(
        SURFACE, f"SELECT sampleid, {', '.join(R(f'quantile_cont(density, {p / 100})', f'p{p}') for p in (85, 90, 95, 99))} FROM surf WHERE density > 0 GROUP BY ALL"
    ),
    "error_summary": q(
        ERRORS,
        f"SELECT count(*) AS n, {R('avg(err)', 'mean_error')}, {R('quantile_cont(err, 0.5)', 'median_error')}, {R('max(err)', 'max_error')}, {R('pow(corr(x, x_true), 2)', 'r2_x')}, {R('pow(corr(y, y_true), 2)', 'r2_y')} FROM err",
    ),
    "error_quantiles": q(ERRORS, f"SELECT {R('avg(err)', 'mean_error')}, {R('quantile_cont(err, 0.5)', 'median_error')}, {R('quantile_cont(err, 0.05)', 'q05')}, {R('quantile_cont(err, 0.95)', 'q95')} FROM err"),
    "error_histogram": q(
        f"{ERRORS}, e AS (SELECT min(err) lo, max(err) hi FROM err)", f"SELECT {BIN('err', 'lo', 'hi', 10)}::INT AS bin, count(*) AS n FROM err, e GROUP BY ALL"
    ),
    "error_by_location": q(ERRORS, f"SELECT {R('x_true')}, {R('y_true')}, {R('avg(err)', 'mean_error')} FROM err GROUP BY err.x_true, err.y_true"),
    "count_by_location": q(f"{SAMPLES}", f"SELECT {R('x')}, {R('y')}, count(*) AS n FROM samples WHERE x IS NOT NULL GROUP BY samples.x, samples.y"),
    "feature_assembly": q(CLINE, "SELECT sampleid, count(*) AS n, sum(dosage * (position // 1000))::BIGINT AS weighted, string_agg(dosage::VARCHAR, '' ORDER BY chrom, position) AS x FROM dos GROUP BY ALL"),
    "sample_order": q(SAMPLES, "SELECT sampleid, row_number() OVER (ORDER BY sampleid) - 1 AS i FROM samples"),
    "site_index": q(f"{WIDE}, {SITES}", "SELECT chrom, position, site FROM indexed"),
    "cap_snps": q(f"{WIDE}, {SITES}", f"SELECT position FROM sites ORDER BY {md5(0, 'chrom', 'position')}, chrom, position LIMIT 100"),
    "pick_samples": q(SAMPLES, f"SELECT sampleid FROM samples ORDER BY {md5(0, 'sampleid')}, sampleid LIMIT 9"),
    "kde_peak": q(PEAK, f"SELECT sampleid, {R('b.gx', 'x')}, {R('b.gy', 'y')} FROM peaks"),
    "hdr_levels": q(
        HDR,
        f"SELECT want.sampleid, want.mass, {R('d0 + (density - d0) * (t - m0) / (m1 - m0)', 'level')} FROM want LEFT JOIN steps ON want.sampleid = steps.sampleid AND m0 < t AND m1 >= t",
    ),
    "hdr_cumulative": q(
        f"{SURFACE}, hc AS (SELECT *, sum(density) OVER (PARTITION BY sampleid ORDER BY round(density, 9) DESC, gx, gy ROWS UNBOUNDED PRECEDING) / sum(density) OVER (PARTITION BY sampleid) AS mass FROM surf)",
        f"SELECT sampleid, {R('gx')}, {R('gy')}, {R('mass')} FROM hc",
    ),
    "union_predictions": q(PRED, f"SELECT sampleid, {R('x')}, {R('y')}, replicate, NULL::INT AS fold FROM pred UNION ALL SELECT sampleid, round(x, 6), round(y, 6), NULL, 1 FROM known"),
    "prediction_set": q(SAMPLES, "SELECT sampleid FROM samples WHERE x IS NULL OR substr(md5(sampleid), 1, 1) >= '8'"),
    "pivot_replicates": q(
        PRED,
        "SELECT sampleid, " + ", ".join(f"round(max({c}) FILTER (replicate = {r}), 6) AS {c}_{r}" for r in range(10) for c in "xy") + " FROM pred GROUP BY ALL",
    ),
    "unpivot_replicates": q(PRED, f"SELECT sampleid, replicate::VARCHAR AS replicate, {R('x')}, {R('y')} FROM pred"),
    "euclid_error": q(ERRORS, f"SELECT sampleid, replicate, {R('err')} FROM err"),
    "great_circle_km": q(CIRCLE, "SELECT vec_id, round(km, 5) AS km FROM circle"),
    "digitize": q(HIST, "SELECT sampleid, xbin::INT AS xbin, ybin::INT AS ybin FROM binned"),
    "binomial2": q(f"{WIDE}, {FREQ}", f"SELECT position, {binomial2('n1::DOUBLE / (2 * called)', 3, 'chrom', 'position')} AS draw FROM freq"),
    "range_penalty_loss": q(
        f"{SAMPLES}, {LOOKUP}", "SELECT sampleid, round(1 + 100 * (1 - valid) * (1 - valid), 6) AS loss FROM valued"
    ),
    "train_test_split": q(f"{SAMPLES}, {ROLES}", "SELECT sampleid, role FROM roles"),
    "phased_split": q(f"{SAMPLES}, {ROLES}", "SELECT concat(sampleid, '_h', h) AS sampleid, role, role = 'pred' AS predicted FROM roles, range(0, 2) q(h)"),
    "holdout_split": q(
        f"{SAMPLES}, {ROLES}",
        "SELECT sampleid, CASE WHEN r < 20 THEN 'holdout' WHEN r < 20 + round_even((1 - 9e-1) * (n - 20), 0) THEN 'val' ELSE 'train' END AS role FROM ranked UNION ALL SELECT sampleid, 'pred' FROM samples WHERE x IS NULL",
    ),
    "systematic_holdouts": q(SAMPLES, "SELECT sampleid, floor((row_number() OVER (ORDER BY sampleid) - 1) / 20)::INT AS holdout_id FROM samples WHERE x IS NOT NULL"),
    "kfold_split": q(f"{SAMPLES}, {ROLES}", "SELECT sampleid, least(r // (n // 5), 4)::INT AS fold FROM ranked"),
    "impute_binomial": q(
        f"{MANY}, {FREQ}",
        f"SELECT sampleid, position, CASE WHEN gone THEN {binomial2('n1::DOUBLE / (2 * called)', 0, 'chrom', 'position', 'sampleid')} ELSE dosage END AS dosage FROM dos JOIN freq USING (chrom, position)",
    ),
    "bootstrap_sites": q(
        f"{CLINE}, {SITES}, n AS (SELECT count(*) AS n FROM sites)",
        f"SELECT replicate::INT AS replicate, draw, position FROM (SELECT replicate, draw, floor({u(0, 'replicate', 'draw')} * n)::BIGINT AS site FROM n, range(0, 5) a(replicate), range(0, 512) b(draw)) JOIN indexed USING (site)",
    ),
    "jackknife_mask": q(
        JACK,
        f"SELECT replicate, sampleid, position, CASE WHEN f.freq IS NOT NULL THEN {binomial2('f.freq', 0, 'replicate', 'chrom', 'position', 'sampleid')} ELSE dosage END AS dosage FROM (SELECT dos.*, r AS replicate FROM dos, range(0, 2) q(r)) LEFT JOIN (SELECT * FROM masked JOIN freq USING (chrom, position)) f USING (replicate, chrom, position)",
    ),
    "window_starts": q(WIDE, f"SELECT DISTINCT {CHROM} AS chrom, (position // 250000 * 250000)::BIGINT AS window_start FROM calls"),
    "sliding_windows": q(
        f"{WIDE}, {SITES}", f"SELECT {CHROM} AS chrom, position, (k * 100000)::BIGINT AS window_start FROM sites, range(0, 100) q(k) WHERE position >= k * 100000 AND position < k * 100000 + 250000"
    ),
    "sites_per_window": q(f"{WIDE}, {SITES}", f"SELECT {CHROM} AS chrom, (position // 250000 * 250000)::BIGINT AS window_start, count(*) AS n_sites FROM sites GROUP BY ALL"),
    "rasterize_range": q(f"{SAMPLES}, {MASK}", 'SELECT "row", col, valid FROM mask'),
}
