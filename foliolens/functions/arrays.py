"""Array helpers that keep per-document work inside one row.

They return SQL text rather than columns: a nested array expression is one call to the
parser instead of hundreds of calls across the Python bridge.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame

BLOCK = 128


def pin(df: DataFrame, columns: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add columns that the optimizer must compute once per row, and drop others.

    A column used once inside a lambda would otherwise be inlined there and computed
    again for every array element. A one-row ``inline`` stops that, without a shuffle.
    """
    fields = ", ".join(f"'{name}', {value}" for name, value in columns.items())
    kept = f"* EXCEPT ({', '.join(drop)})" if drop else "*"
    return df.selectExpr(kept, f"inline(array(named_struct({fields})))")


def sql_string(text: str) -> str:
    """A SQL string literal; raw where it can be, so that patterns stay readable in plans.

    ``${...}`` is masked because the parser would take it for a variable.
    """
    if "'" not in text and "${" not in text:
        return f"r'{text}'"
    masked = text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
    return f"'{masked}'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def blocks(arr: str, size: int = BLOCK) -> str:
    """Cut an array (named by a column or lambda variable) into arrays of ``size`` elements."""
    count = f"int((size({arr}) + {size - 1}) div {size})"
    return (f"transform(filter(sequence(0, {count}), k -> k < {count}),"
            f" k -> slice({arr}, k * {size} + 1, {size}))")


def running_totals(arr: str, kind: str = "int", size: int = BLOCK) -> str:
    """Running sums of a numeric array, the own element included.

    Growing one array element by element copies it each time, which is quadratic in
    its length. Here only arrays of ``size`` elements grow; each block starts from the
    last total of the block before, and repeats that as its first element.
    """
    grow = "(d, x) -> concat(d, array(element_at(d, -1) + x))"
    start = "array(element_at(element_at(done, -1), -1))"
    return (f"flatten(transform(aggregate({blocks(arr, size)}, array(array(cast(0 AS {kind}))),"
            f" (done, part) -> concat(done, array(aggregate(part, {start}, {grow})))),"
            f" p -> slice(p, 2, size(p) - 1)))")


def search_steps(arr: str) -> str:
    """The jump lengths of a binary search in an array: powers of two, largest first."""
    powers = ", ".join(str(1 << b) for b in reversed(range(31)))
    return f"filter(array({powers}), p -> p <= size({arr}))"


def count_while(steps: str, test: Callable[[str], str]) -> str:
    """How many leading elements pass a test that fails for all after the first failure.

    ``steps`` = ``search_steps(arr)``; ``test`` gets an index, as SQL text, that may lie past
    the end, where ``get`` gives null and the test does not pass.
    """
    return f"aggregate({steps}, 0, (n, step) -> if({test('n + step - 1')}, n + step, n))"
