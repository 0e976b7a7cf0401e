"""Postfix sample expressions compiled into one Column, whose size grows with the program and no faster: every intermediate value is bound once.

A program is a list of tokens: ("const", n), ("input", column) or the name of an operator. Every operator's result is clamped to
the signed intermediate range and the last value to the output depth. All arithmetic is 64-bit and saturates.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.binding import let

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Operators of a program that is nested into one expression; longer ones are folded token by token.
NESTED = 12
UNARY = {"neg", "abs", "not", "log2"}
BINARY = {"add", "sub", "mul", "div", "and", "or", "xor", "pow", "min", "max"}


def _long(n: int) -> Column:
    return F.lit(n).cast("long") if n != LOW else F.lit(LOW + 1).cast("long") - 1


def _saturated(exact: Column, negative: Column) -> Column:
    return F.coalesce(exact, F.when(negative, _long(LOW)).otherwise(_long(HIGH)))


def _multiply(a: Column, b: Column) -> Column:
    return _saturated(F.try_multiply(a, b), (a < 0) != (b < 0))


def _power(a: Column, e: Column) -> Column:
    odd = e.bitwiseAND(_long(1)) == 1
    by_hand = F.aggregate(F.sequence(_long(1), F.least(e, _long(64))), _long(1), lambda acc, _: _multiply(acc, a))
    return (
        F.when(e < 0, F.raise_error(F.lit("unsupported: negative exponent")).cast("long")).when(e == 0, _long(1)).when(a.isin(0, 1), a)
        .when(a == -1, F.when(odd, _long(-1)).otherwise(_long(1)))
        .when(e >= 64, F.when((a < 0) & odd, _long(LOW)).otherwise(_long(HIGH))).otherwise(by_hand)
    )


def _apply(op: str, args: list[Column]) -> Column:
    a, b = args[0], args[-1]
    negated = F.when(a == _long(LOW), _long(HIGH)).otherwise(-a)
    match op:
        case "neg":
            return negated
        case "abs":
            return F.when(a < 0, negated).otherwise(a)
        case "not":
            return F.bitwise_not(a)
        case "log2":
            return F.when(a <= 0, _long(0)).otherwise((F.length(F.bin(a)) - 1).cast("long"))
        case "add":
            return _saturated(F.try_add(a, b), a < 0)
        case "sub":
            return _saturated(F.try_subtract(a, b), a < 0)
        case "mul":
            return _multiply(a, b)
        case "div":
            whole = F.when(b == -1, negated).otherwise(F.call_function("div", a, F.when(b != 0, b)))
            return F.when(b == 0, F.raise_error(F.lit("bitstream: division by zero")).cast("long")).otherwise(whole)
        case "and":
            return a.bitwiseAND(b)
        case "or":
            return a.bitwiseOR(b)
        case "xor":
            return a.bitwiseXOR(b)
        case "pow":
            return _power(a, b)
        case "min":
            return F.least(a, b)
        case _:
            return F.greatest(a, b)


def _clamped(op: str, low: Column, high: Column) -> Callable[..., Column]:
    """An operator on values that are bound, clamped; null if one of them is."""

    def run(*args: Column) -> Column:
        missing = F.lit(False)
        for x in args:
            missing = missing | x.isNull()
        return F.when(~missing, let(_apply(op, list(args)), lambda v: F.least(F.greatest(v, low), high)))

    return run


def _second(f: Callable[..., Column], value: Column) -> Callable[[Column], Column]:
    """f with its second argument bound to value."""
    return lambda a: let(value, lambda b: f(a, b))


def _stack_machine(tokens: list, low: Column, high: Column) -> Column:
    """The program's value by a fold over its tokens with an array as the stack: one expression of fixed size, for programs too long to nest."""
    names = sorted({v for t in tokens if isinstance(t, tuple) for k, v in [t] if k == "input"})
    ops = [None, "input", *sorted(UNARY), *sorted(BINARY)]
    rows = []
    for t in tokens:
        kind, value = t if isinstance(t, tuple) else (t, 0)
        op = 0 if kind == "const" else ops.index(kind)
        rows.append(F.struct(F.lit(op).alias("op"), (_long(value) if kind == "const" else _long(names.index(value)) if kind == "input" else _long(0)).alias("value")))
    inputs = F.array(*(F.col(n).cast("long") for n in names)) if names else F.expr("cast(array() as array<bigint>)")

    def step(stack: Column, token: Column) -> Column:
        def on_top(top: Column) -> Column:
            under = F.get(stack, F.size(stack) - 2)
            one = functools.reduce(lambda c, op: c.when(token["op"] == ops.index(op), _clamped(op, low, high)(top)), sorted(UNARY), F.when(F.lit(False), top))
            two = let(under, lambda a: functools.reduce(lambda c, op: c.when(token["op"] == ops.index(op), _clamped(op, low, high)(a, top)), sorted(BINARY), F.when(F.lit(False), top)))
            binary = token["op"] >= ops.index(sorted(BINARY)[0])
            return F.when(binary, F.concat(F.slice(stack, F.lit(1), F.size(stack) - 2), F.array(two))).otherwise(F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(one)))

        pushed = F.when(token["op"] == 0, token["value"]).otherwise(F.get(inputs, token["value"].cast("int")))
        return F.when(token["op"] < 2, F.concat(stack, F.array(pushed))).otherwise(let(F.get(stack, F.size(stack) - 1), on_top))

    return F.get(F.aggregate(F.array(*rows), F.expr("cast(array() as array<bigint>)"), step), F.lit(0))


def compile_expression(tokens: list, bits: int = 32, depth: int = 8) -> Column:
    """The program's Column. bits: intermediate width (8, 16, 32, 64); depth: bits of the output.

    Raises ValueError for unknown tokens and for programs that don't leave one value. Null inputs give null.
    """
    if bits not in (8, 16, 32, 64):
        raise ValueError("intermediate width must be 8, 16, 32 or 64")
    low, high = _long(-(1 << (bits - 1))), _long((1 << (bits - 1)) - 1)
    stack: list[Column] = []
    nested = sum(not isinstance(t, tuple) for t in tokens) <= NESTED
    for token in tokens:
        if isinstance(token, tuple):
            kind, value = token
            if kind not in ("const", "input"):
                raise ValueError(f"unsupported token {token!r}")
            stack.append(_long(value) if kind == "const" else F.col(value).cast("long"))
            continue
        need = 1 if token in UNARY else 2 if token in BINARY else 0
        if not need:
            raise ValueError(f"unsupported token {token!r}")
        if len(stack) < need:
            raise ValueError("stack underflow")
        args = stack[-need:]
        del stack[-need:]
        if not nested:  # checked only
            stack.append(args[0])
            continue
        held = _clamped(token, low, high)
        if need == 1:
            stack.append(let(args[0], held))
        else:
            stack.append(let(args[0], _second(held, args[1])))
    if len(stack) != 1:
        raise ValueError("a program must leave one value")
    last = stack[0] if nested else _stack_machine(tokens, low, high)
    return let(last, lambda v: F.when(v.isNotNull(), F.least(F.greatest(v, _long(0)), _long((1 << depth) - 1))))
