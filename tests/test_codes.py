"""Integer codes: literal values, and round trips over ranges."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tesela.functions import codes

GAMMA = {1: "0", 2: "100", 3: "101", 4: "11000", 17: "111100001"}
VBYTE = {1: "10000001", 5: "10000101", 127: "11111111", 128: "0000000110000000", 300: "0000001010101100"}
CALPHA = {17: "000010001", 9: "0001001", 63: "00000111111"}


def test_expressions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k,) for k in [*range(1, 400), 2**31, 2**40 + 5]], "k long")
    rows = df.select("k", codes.gamma_encode(F.col("k")).alias("g"), codes.vbyte_encode(F.col("k")).alias("v"), codes.calpha_encode(F.col("k")).alias("a"), codes.headless(F.col("k")).alias("h"), codes.gamma_bits(F.col("k")).alias("gb"), codes.vbyte_bits(F.col("k")).alias("vb"), codes.ceil_log2(F.col("k")).alias("c"), codes.binary_to_int(F.bin("k")).alias("i")).collect()
    by = {r.k: r for r in rows}
    assert {k: by[k].g for k in GAMMA} == GAMMA and {k: by[k].v for k in VBYTE} == VBYTE and {k: by[k].a for k in CALPHA} == CALPHA
    assert [by[k].h for k in (1, 2, 3, 4)] == ["", "0", "1", "00"]
    for r in rows:
        assert (len(r.g), len(r.v), r.c, r.i) == (r.gb, r.vb, (r.k - 1).bit_length(), r.k)
    for column, values in (("g", codes.gamma_values), ("v", codes.vbyte_values), ("a", codes.calpha_values)):
        assert list(values("".join(r[column] for r in rows))) == [r.k for r in rows]


def test_arrow_decoders(spark):
    df = spark.createDataFrame([("0100101",), (None,), ("",)], "b string")
    assert [r[0] for r in df.select(codes.gamma_decode("b")).collect()] == [[1, 2, 3], None, []]


@pytest.mark.parametrize(("n", "bits"), [(1, "11"), (6, "10011"), (33, "10101011")])
def test_fibonacci(n, bits):
    assert codes.fibonacci_encode(n) == bits


@pytest.mark.parametrize(("n", "bits"), [(1, "0"), (2, "100"), (3, "110"), (31, "10100111110")])
def test_omega(n, bits):
    assert codes.omega_encode(n) == bits


def test_byte_code():
    assert codes.byte_code(10, 2) == "01000111" and codes.byte_code(10, 3) == "001011111"


@given(st.lists(st.integers(1, 10**7), min_size=1, max_size=20))
def test_round_trips(values):
    assert list(codes.fibonacci_values("".join(map(codes.fibonacci_encode, values)))) == values
    assert list(codes.omega_values("".join(map(codes.omega_encode, values)))) == values
    for size in range(2, 7):
        assert list(codes.byte_code_values("".join(codes.byte_code(v, size) for v in values), size)) == values
    for base in (2, 16, 36, 70):
        assert [codes.from_base(codes.to_base(v, base), base) for v in values] == values


def test_change_base():
    assert codes.change_base("ff", "0123456789abcdef", "01") == "11111111"
