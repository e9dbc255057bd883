"""Queries on curves made from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import read
from ..operators import spectra
from .catalogue import _r, query

CURVES = "c AS (SELECT vec_id, embedding::DOUBLE[] AS y, len(embedding) AS n FROM embeddings)"
AREA = "list_sum([0.5 * (y[i] + y[i + 1]) FOR i IN range(1, n)])"


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.sequence(F.lit(0), F.size("embedding") - 1).alias("x"), F.col("embedding").alias("y"))


@query(f"""+ h AS (SELECT vec_id, y[1:n // 2] AS x, y[n // 2 + 1:] AS y, n // 2 AS n FROM c)
SELECT vec_id, {_r('list_min(x)')} AS r_solution, {_r('list_max(x)')} AS r_polarization, {_r('list_max(x) - list_min(x)')} AS semicircle_diameter, {_r('list_max(y)')} AS max_imaginary, {_r('x[list_position(y, list_max(y))]')} AS peak_frequency_position,
{_r('coalesce((y[n] - y[n - n // 5 + 1]) / nullif(x[n] - x[n - n // 5 + 1], 0), 0)')} AS low_freq_tail_slope FROM h""", CURVES)
def impedance_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of an embedding against the second one, as an arc."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), half).alias("x"), F.slice("embedding", half + 1, half).alias("y"))
    return spectra.impedance(rows, ["vec_id"], "x", "y")


@query(f"""+ b AS (SELECT *, list_max(y) AS top, list_position(y, list_max(y)) AS p, list_sum(list_sort(y)[1:n // 10]) / (n // 10) AS base FROM c), h AS (SELECT *, base + (top - base) / 2 AS half FROM b)
SELECT vec_id, {_r('(p - 1)::DOUBLE')} AS peak_wavelength, {_r('top')} AS peak_absorbance, {_r('(coalesce([i FOR i IN range(p, n + 1) IF y[i] <= half][1], n) - coalesce([i FOR i IN range(1, p + 1) IF y[i] <= half][-1], 1))::DOUBLE')} AS fwhm,
{_r(AREA)} AS total_absorbance, {_r('base')} AS baseline_level, {_r('top - base')} AS peak_prominence FROM h""", CURVES)
def absorbance_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.absorbance(_curves(spark, sf_dir), ["vec_id"], "x", "y")


@query(f"""+ b AS (SELECT *, list_max(y) AS top, list_sum(list_sort(y)[1:n // 5]) / (n // 5) AS base FROM c),
q AS (SELECT *, [i FOR i IN range(1, n + 1) IF (i = 1 OR y[i] > y[i - 1]) AND (i = n OR y[i] > y[i + 1]) AND y[i] - base > (top - base) * 0.1] AS found FROM b),
k AS (SELECT *, CASE WHEN len(found) > 0 THEN found ELSE [list_position(y, top)] END AS peaks FROM q),
e AS (SELECT vec_id, count(*) AS m, max(y[p]) AS best, arg_max(p, (y[p], -p)) AS first, avg(coalesce([i FOR i IN range(p, n + 1) IF y[i] <= base + (y[p] - base) / 2][1], least(n, p + 1)) - coalesce([i FOR i IN range(1, p + 1) IF y[i] <= base + (y[p] - base) / 2][-1], greatest(1, p - 1))) AS width
  FROM (SELECT *, unnest(peaks) AS p FROM k) GROUP BY 1)
SELECT vec_id, {_r('(first - 1)::DOUBLE')} AS primary_peak_angle, {_r('best')} AS primary_peak_intensity, {_r('m::DOUBLE')} AS n_peaks,
{_r(f'CASE WHEN {AREA} > 0 THEN list_sum([0.5 * (greatest(0, y[i] - base) + greatest(0, y[i + 1] - base)) FOR i IN range(1, n)]) / {AREA} ELSE 0 END')} AS crystallinity_index, {_r('width')} AS mean_peak_width, {_r('base')} AS background_level FROM k JOIN e USING (vec_id)""", CURVES)
def diffraction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.diffraction(_curves(spark, sf_dir), ["vec_id"], "x", "y")
