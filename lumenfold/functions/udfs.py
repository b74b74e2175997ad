"""The kernels as Arrow-batched functions on array columns, and their registration for SQL.

Null arguments give null. Input that a kernel refuses (too short, constant, malformed)
gives null, or an error with on_error="raise".
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import __version__
from lumenfold.functions import kernels as K
from lumenfold.functions import vector as V


def array_udf(kernel: Callable, returns: str, on_error: str = "null") -> Callable[..., Column]:
    """A column function that applies `kernel` to the values of each row, batch by batch."""
    def run(*cols: pd.Series) -> pd.Series:
        out = []
        for args in zip(*cols):
            if any(a is None or (isinstance(a, float) and np.isnan(a)) for a in args):
                out.append(None)
                continue
            try:
                out.append(kernel(*args))
            except ValueError:
                if on_error == "raise":
                    raise
                out.append(None)
        return pd.Series(out, dtype=object)

    if returns.startswith(("struct<", "array<struct<")):  # as JSON inside, so that null rows stay null structs
        def text(*cols: pd.Series) -> pd.Series:
            return run(*cols).map(lambda r: None if r is None else json.dumps(r))

        inner = F.pandas_udf(text, "string")
        return lambda *cols: F.from_json(inner(*cols), returns)
    return F.pandas_udf(run, returns)


DRIFT = "struct<drift:double,recent_alpha:double,baseline_alpha:double>"
PERIODOGRAM = "struct<freqs:array<double>,power:array<double>>"
PERSISTENCE = "struct<n_h0_bars:int,h0_bars:array<double>,betti1:int>"
CYCLE = "struct<detected:boolean,cycle_len:int,at_index:int>"
LOOP = "struct<dfa_exponent:double,is_loop_detected:boolean>"
VASCULAR = "struct<mean_tortuosity:double,branch_density:double,fractal_dimension:double>"
NERVE = "struct<fiber_length_density:double,branch_density:double,fractal_dimension:double>"
CORTICAL = "struct<mesh_area:double,hull_area:double,gyrification_index:double>"
MORPHOLOGY = "struct<dimension:double,lacunarity:double>"
PORTFOLIO = "struct<sharpe:double,weights:array<double>>"
PORTFOLIOS = "array<struct<sharpe:double,weights:array<double>>>"
PARETO = "array<struct<return:double,risk:double,weights:array<double>>>"
SUBSET = "struct<score:double,weights:array<double>>"
SEARCH = "struct<dim:int,generations:int,population_size:int,best_point:array<double>,best_fit:double,best_fit_per_gen:array<double>>"


def _ints(f: Callable, *at: int) -> Callable:
    """f with the arguments at these places as int."""
    return lambda *a: f(*(int(x) if i in at else x for i, x in enumerate(a)))


def _packed_cycle(states, hamming: int = 0) -> dict:
    return K.detect_cycle([bytes(s) for s in states], int(hamming))


def _hex_cycle(text: str, n_bits: int, hamming: int = 0) -> dict:
    """Cycle over a JSON list of hexadecimal fingerprints of n_bits each."""
    states = [bytes.fromhex(h) for h in json.loads(text)]
    if any(len(s) != (int(n_bits) + 7) // 8 for s in states):
        raise ValueError("a fingerprint has not n_bits")
    return K.detect_cycle(states, int(hamming))


#: name -> (kernel, result type), for arrays in SQL and in DataFrames
ARRAY_FUNCTIONS: dict[str, tuple[Callable, str]] = {
    "dimension_dfa": (K.dfa, "double"),
    "dimension_drift": (_ints(K.dfa_drift, 1), DRIFT),
    "dimension_boxcount": (_ints(K.box_dimension, 1), "double"),
    "change_point_detect": (_ints(K.change_points, 1, 3), "array<int>"),
    "periodogram": (_ints(K.periodogram, 1), PERIODOGRAM),
    "spectrogram_entropy": (_ints(K.spectral_entropy, 1, 2, 3), "array<double>"),
    "tda_persistence_diagram": (_ints(K.persistence, 1, 2, 4), PERSISTENCE),
    "state_fingerprint": (_ints(K.fingerprint, 1, 2), "binary"),
    "cycle_detect": (_hex_cycle, CYCLE),
    "detect_loop": (_ints(K.detect_loop, 1, 2, 3, 4), LOOP),
    "vascular_network": (K.vascular_network, VASCULAR),
    "cortical_folding": (K.cortical_folding, CORTICAL),
    "nerve_plexus_metric": (_ints(K.nerve_plexus, 1), NERVE),
    "morphological_complexity": (_ints(K.morphology, 1), MORPHOLOGY),
    "optimize_portfolio": (_ints(K.portfolio, 2, 3), PORTFOLIO),
    "optimize_portfolio_multimodal": (_ints(K.portfolios, 2, 3, 6), PORTFOLIOS),
    "optimize_portfolio_multimodal_pareto": (_ints(K.pareto_front, 2, 3, 4, 5), PARETO),
    "optimize_subset": (_ints(K.subset, 2), SUBSET),
    "search_debug": (_ints(K.diffusion_search, 1, 2, 3), SEARCH),
}


def array_function(name: str, on_error: str = "null") -> Callable[..., Column]:
    kernel, returns = ARRAY_FUNCTIONS[name]
    return array_udf(kernel, returns, on_error)


def fingerprints(vec: Column, n_bits: int, seed: int = 0) -> Column:
    """Packed sign bits of all vectors of a batch by one matrix product."""
    def run(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        there = np.flatnonzero(v.notna().to_numpy())
        sizes = np.array([len(v.iloc[k]) for k in there])
        for dim in np.unique(sizes):
            at = there[sizes == dim]
            x = np.stack(v.iloc[at].to_numpy()).astype(float)
            bits = np.packbits(x @ K.plane_signs(n_bits, int(dim), seed).T >= 0, axis=1)
            for k, row in zip(at, bits):
                out.iloc[k] = row.tobytes()
        return out

    return F.pandas_udf(run, "binary")(vec)


def ordered_series(df: DataFrame, by: list[str], order: str, value: str, name: str = "series") -> DataFrame:
    """One row per group with its values as an array, in order."""
    s = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda x: x["v"])
    return df.groupBy(*by).agg(s.alias(name))


# ---- SQL --------------------------------------------------------------------------------------

def _sql_scalars() -> dict[str, tuple[str, str]]:
    """SQL functions written as expressions: name -> (parameters and result, body)."""
    pair = "aggregate(zip_with(cast(a as array<double>), cast(b as array<double>), (x, y) -> {}), 0d, (s, x) -> s + x)"
    same = "if(size(a) <> size(b), cast(raise_error('vector dim mismatch') as double), {})"
    n = "sqrt(aggregate(cast({0} as array<double>), 0d, (s, x) -> s + x * x))"
    two = "a array<double>, b array<double>"
    l2 = same.format(pair.format("(x - y) * (x - y)"))
    ip = same.format(pair.format("x * y"))
    cos = f"if({n.format('a')} * {n.format('b')} = 0, 0d, {ip} / nullif({n.format('a')} * {n.format('b')}, 0d))"
    return {
        "vector": ("dim int) RETURNS array<float>", "array_repeat(cast(0 as float), dim)"),
        "vector_from_text": ("t string) RETURNS array<float>", "transform(split(regexp_replace(t, '[\\\\[\\\\]\\\\s]', ''), ','), x -> cast(x as float))"),
        "vector_to_json": ("v array<double>) RETURNS string", "to_json(cast(v as array<float>))"),
        "vector_dims": ("v array<double>) RETURNS int", "if(v is null, null, size(v))"),
        "vector_l2_distance": (f"{two}) RETURNS double", f"sqrt({l2})"),
        "vector_l2_squared": (f"{two}) RETURNS double", l2),
        "vector_cosine_similarity": (f"{two}) RETURNS double", cos),
        "vector_cosine_distance": (f"{two}) RETURNS double", f"1d - {cos}"),
        "search": (f"{two}) RETURNS double", f"1d - {cos}"),
        "vector_negative_inner_product": (f"{two}) RETURNS double", f"-({ip})"),
        "vector_add": (f"{two}) RETURNS array<double>", "zip_with(a, b, (x, y) -> x + y)"),
        "vector_sub": (f"{two}) RETURNS array<double>", "zip_with(a, b, (x, y) -> x - y)"),
        "vector_scale": ("v array<double>, s double) RETURNS array<double>", "transform(v, x -> x * s)"),
        "vector_norm": ("v array<double>) RETURNS double", n.format("v")),
        "vector_normalize": ("v array<double>) RETURNS array<double>", f"transform(v, x -> coalesce(x / nullif({n.format('v')}, 0d), 0d))"),
        "vector_lp_distance": (f"{two}, p double) RETURNS double", "pow(" + same.format(pair.format("pow(abs(x - y), p)")) + ", 1d / p)"),
    }


def _for_sql(kernel: Callable, plain: bool) -> Callable:
    def call(*cols: pd.Series) -> pd.Series:
        out = []
        for args in zip(*cols):
            try:
                r = None if any(a is None for a in args) else kernel(*args)
            except ValueError:
                r = None
            out.append(r if plain or r is None else json.dumps(r))
        return pd.Series(out, dtype=object)

    return call


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make all functions known to SQL under `prefix` + name; returns the names."""
    names = []
    for name, (head, body) in _sql_scalars().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({head} RETURN {body}")
        names.append(prefix + name)
    for name, (kernel, returns) in ARRAY_FUNCTIONS.items():
        kind = returns if not returns.startswith(("struct", "array<struct")) else "string"
        spark.udf.register(prefix + name, F.pandas_udf(_for_sql(kernel, kind == returns), kind))
        names.append(prefix + name)
    spark.udf.register(prefix + "vector_quantize_int8", F.pandas_udf(lambda v: v.map(lambda x: None if x is None else json.dumps(_int8(x))), "string"))
    spark.udf.register(prefix + "vector_quantize_binary", F.pandas_udf(lambda v: v.map(lambda x: None if x is None else np.packbits(np.asarray(x) >= 0).tobytes()), "binary"))
    spark.udf.register(prefix + "vector_hamming_distance", F.pandas_udf(_hamming, "int"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}version() RETURNS string RETURN '{__version__}'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}edition() RETURNS string RETURN 'open'")
    return [*names, *(prefix + x for x in ("vector_quantize_int8", "vector_quantize_binary", "vector_hamming_distance", "version", "edition"))]


def _int8(x) -> dict:
    a = np.asarray(x, dtype=float)
    s = float(np.abs(a).max()) / 127.0 if len(a) else 0.0
    return {"scale": s, "codes": (np.sign(a) * np.floor(np.abs(a) / s + 0.5)).astype(int).tolist() if s else [0] * len(a)}


def _by_length(col: pd.Series) -> list[tuple[int, np.ndarray]]:
    """(length, places) of the values that are there, for each length."""
    there = np.flatnonzero(col.notna().to_numpy())
    sizes = np.fromiter((len(x) for x in col.iloc[there]), dtype=np.int64, count=len(there))
    return [(int(n), there[sizes == n]) for n in np.unique(sizes)]


def _hamming(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(a), dtype=object)
    a, b = a.reset_index(drop=True), b.reset_index(drop=True)
    a = a.where(b.notna(), None)
    for n, at in _by_length(a):
        x, y = a.iloc[at], b.iloc[at]
        if not n or (y.map(len) != n).any():
            raise ValueError("packed vectors differ in length or are empty")
        bits = np.frombuffer(b"".join(x), dtype=np.uint8) ^ np.frombuffer(b"".join(y), dtype=np.uint8)
        out.iloc[at] = np.bitwise_count(bits).reshape(-1, n).sum(axis=1, dtype=np.int64)
    return out


# ---- binary codec -------------------------------------------------------------------------------

def encode_packed(v: Column) -> Column:
    """array -> bytes: u16 length, u16 zero, float32 each, little endian."""
    def run(col: pd.Series) -> pd.Series:
        out = [None] * len(col)
        for n, at in _by_length(col):
            rows = np.empty((len(at), 4 + 4 * n), dtype=np.uint8)
            rows[:, :4] = np.array([n, 0], dtype="<u2").view(np.uint8)
            if n:
                rows[:, 4:] = np.stack(col.iloc[at].to_numpy()).astype("<f4").view(np.uint8).reshape(len(at), -1)
            for k, row in zip(at.tolist(), rows):
                out[k] = row.tobytes()
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "binary")(v)


def decode_packed(b: Column) -> Column:
    """bytes with or without the header -> array<float>; malformed bytes raise an error."""
    def run(col: pd.Series) -> pd.Series:
        out = [None] * len(col)
        for n, at in _by_length(col):
            if not n or n % 4:
                raise ValueError("malformed vector")
            rows = np.frombuffer(b"".join(col.iloc[at]), dtype=np.uint8).reshape(-1, n)
            head = np.array([(n - 4) // 4 & 0xFFFF, 0], dtype="<u2").view(np.uint8)
            headed = (rows[:, :4] == head).all(axis=1) & (n >= 8) & ((n - 4) // 4 <= 0xFFFF)
            for k, h, x in zip(at.tolist(), headed.tolist(), rows.view("<f4")):
                out[k] = x[1:] if h else x
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<float>")(b)


__all__ = ["ARRAY_FUNCTIONS", "V", "array_function", "array_udf", "decode_packed", "encode_packed", "fingerprints", "ordered_series", "register"]
