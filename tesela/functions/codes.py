"""Integer codes as strings of 0 and 1: expressions where Catalyst can say them, Arrow UDFs for sequential decoders."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_encode(k: Column) -> Column:
    """Elias gamma: the number of bits behind the leading one in unary (ones, closed by a zero), then those bits. k >= 1."""
    b = F.bin(k)
    return F.concat(F.repeat(F.lit("1"), F.length(b) - 1), F.lit("0"), F.substring(b, F.lit(2), F.length(b)))


def calpha_encode(k: Column) -> Column:
    """As gamma with zeros in front of the whole number."""
    b = F.bin(k)
    return F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b)


def vbyte_encode(k: Column) -> Column:
    """Groups of seven bits, high ones first; the first bit of a byte is 1 on the last."""
    groups = F.ceil(F.length(F.bin(k)) / 7).cast("int")
    byte = lambda i: F.concat(F.when(i == 0, "1").otherwise("0"), F.lpad(F.bin(F.call_function("shiftright", k.cast("long"), (i * 7).cast("int")).bitwiseAND(F.lit(127))), 7, "0"))
    return F.array_join(F.transform(F.sequence(groups - 1, F.lit(0), F.lit(-1)), byte), "")


def gamma_bits(k: Column) -> Column:
    return 2 * (F.length(F.bin(k)) - 1) + 1


def vbyte_bits(k: Column) -> Column:
    return (8 * F.ceil(F.length(F.bin(k)) / 7)).cast("int")


def fixed_width(k: Column, width: int) -> Column:
    return F.lpad(F.bin(k), width, "0")


def headless(k: Column) -> Column:
    """Binary without the leading one."""
    return F.substring(F.bin(k), F.lit(2), F.length(F.bin(k)))


def binary_to_int(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("long")


def ceil_log2(n: Column) -> Column:
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))


def gamma_values(bits: str) -> Iterator[int]:
    at = 0
    while at < len(bits):
        zero = bits.index("0", at)
        size = zero - at
        yield int("1" + bits[zero + 1 : zero + 1 + size], 2)
        at = zero + 1 + size


def vbyte_values(bits: str) -> Iterator[int]:
    value = 0
    for at in range(0, len(bits), 8):
        value = value << 7 | int(bits[at + 1 : at + 8], 2)
        if bits[at] == "1":
            yield value
            value = 0


def calpha_values(bits: str) -> Iterator[int]:
    at = 0
    while at < len(bits):
        size = bits.index("1", at) - at + 1
        yield int(bits[at + size - 1 : at + 2 * size - 1], 2)
        at += 2 * size - 1


def fibonacci_encode(n: int) -> str:
    """Zeckendorf digits, smallest first, closed by a one. n >= 1."""
    terms = [1, 2]
    while terms[-1] <= n:
        terms.append(terms[-1] + terms[-2])
    out = []
    for t in reversed(terms):
        if t <= n:
            out.append("1")
            n -= t
        elif out:
            out.append("0")
    return "".join(reversed(out)) + "1"


def fibonacci_values(bits: str) -> Iterator[int]:
    total, a, b, last = 0, 1, 2, "0"
    for bit in bits:
        if bit == "1" and last == "1":
            yield total
            total, a, b, last = 0, 1, 2, "0"
            continue
        total += a if bit == "1" else 0
        a, b, last = b, a + b, bit


def omega_encode(n: int) -> str:
    """Elias omega: binary groups, each the length less one of the next, closed by a zero. n >= 1."""
    out = "0"
    while n > 1:
        b = format(n, "b")
        out = b + out
        n = len(b) - 1
    return out


def omega_values(bits: str) -> Iterator[int]:
    at, n = 0, 1
    while at < len(bits):
        if bits[at] == "0":
            yield n
            at, n = at + 1, 1
        else:
            at, n = at + n + 1, int(bits[at : at + n + 1], 2)


def byte_code(n: int, size: int) -> str:
    """Digits in base 2**size - 1 of `size` bits each, closed by a digit of ones. n >= 0."""
    base, out = (1 << size) - 1, []
    while True:
        out.append(format(n % base, f"0{size}b"))
        n //= base
        if not n:
            return "".join(reversed(out)) + "1" * size


def byte_code_values(bits: str, size: int) -> Iterator[int]:
    base, value = (1 << size) - 1, 0
    for at in range(0, len(bits), size):
        digit = int(bits[at : at + size], 2)
        if digit == base:
            yield value
            value = 0
        else:
            value = value * base + digit


#: Digits of the larger bases, in natural order.
DIGITS = string.digits + string.ascii_letters + "-_.~!*'()"


def to_base(n: int, base: int, digits: str = DIGITS) -> str:
    if not 2 <= base <= len(digits):
        raise ValueError("no digits for this base")
    out = ""
    while True:
        n, r = divmod(n, base)
        out = digits[r] + out
        if not n:
            return out


def from_base(text: str, base: int, digits: str = DIGITS) -> int:
    value = 0
    for c in text:
        value = value * base + digits.index(c)
    return value


def change_base(text: str, source: str, target: str) -> str:
    """A number written in one alphabet, in another one."""
    return to_base(from_base(text, len(source), source), len(target), target)


def decoder(values: Callable[[str], Iterator[int]]):
    """An Arrow UDF from strings of bits to arrays of numbers."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def decode(bits: pd.Series) -> pd.Series:
        return bits.map(lambda b: None if b is None else list(values(b)))

    return decode


gamma_decode = decoder(gamma_values)
vbyte_decode = decoder(vbyte_values)
calpha_decode = decoder(calpha_values)
fibonacci_decode = decoder(fibonacci_values)
omega_decode = decoder(omega_values)
