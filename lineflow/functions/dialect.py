"""One relational text, two engines.

Operators are declared as SQL over a line relation.  Spark runs the Spark form; the DuckDB form of the same declaration
is the oracle.  Regular expressions are written once in RE2 syntax and translated for java.util.regex, because the two
differ in `$`, `.`, `\\s`, `\\b` and case folding.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Lines that a task of a window operator takes (about), and how many tasks the engine may choose itself.
TASK_LINES, FEW_TASKS = 150_000, 12
_SPACE = r" \t\n\f\r"
_WORD = "0-9A-Za-z_"
_EDGE = rf"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"


#: What surely begins, or ends, with a word character: a class of such, or literal alternatives, that stands once at least.
_ONCE = r"(?![*?]|\{0|\{,)"
_BEGINS = re.compile(rf"(?:[{_WORD}]|\\[dw]|\[(?:0-9|A-Z|a-z|a-f|A-F|[{_WORD}](?!-))+\]){_ONCE}|\((?:\?:)?[{_WORD}]+(?:\|[{_WORD}]+)*\){_ONCE}")
_ENDS = re.compile(rf"(?:(?<!\\)[{_WORD}]|\[(?:0-9|A-Z|a-z|a-f|A-F|[{_WORD}](?!-))+\](?:\+|\{{[1-9]\d*(?:,\d*)?\}})?)$")


def java(pattern: str) -> str:
    """The java.util.regex form of an RE2 pattern."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i : i + 2]
            i += 2
            if e == r"\s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            elif e == r"\S" and not inside:
                out.append(f"[^{_SPACE}]")
            elif e == r"\b" and not inside:
                # Next to a literal word character one look decides; the general form is slow.
                if _BEGINS.match(pattern, i):
                    out.append(f"(?<![{_WORD}])")
                elif _ENDS.search(pattern[: i - 2]):
                    out.append(f"(?![{_WORD}])")
                else:
                    out.append(_EDGE)
            else:
                out.append(e)
            continue
        if inside:
            # A bare bracket inside a class is a nested class in Java.
            out.append(r"\[" if c == "[" else r"\&" if c == "&" else c)
            inside = c != "]"
        elif c == "[":
            inside = True
            step = 2 if pattern[i + 1 : i + 2] == "^" else 1
            out.append(pattern[i : i + step])
            i += step
            if pattern[i : i + 1] == "]":
                out.append(r"\]")
                i += 1
            continue
        else:
            out.append({"$": r"\z", ".": r"[^\n]"}.get(c, c))
        i += 1
    return "".join(out).replace("(?i)", "(?iu)")


class Dialect:
    """Renderer of the few expressions whose spelling differs."""

    name = ""

    def table(self, name: str) -> str:
        raise NotImplementedError

    def spread(self, src: str, table: str, times: int = 1) -> str:
        """src, which has `times` lines for each one of a table, dealt by doc over tasks whose share doesn't grow."""
        return src

    def any_of(self, patterns: list[str] | tuple[str, ...], x: str) -> str:
        return "(" + " or ".join(self.match(x, p) for p in patterns) + ")"

    def trim(self, x: str) -> str:
        return self.sub(x, r"^[ \t\n\f\r\v]+|[ \t\n\f\r\v]+$", "")

    def starts(self, x: str, s: str) -> str:
        return f"substr({x}, 1, {len(s)}) = {self.lit(s)}"


class Spark(Dialect):
    name = "spark"

    def __init__(self, sf_dir: str = "", lines: Callable[[str], int] | None = None):
        """`lines` counts a table's lines; without it relations are dealt as the session's settings say."""
        self.sf_dir, self.lines = sf_dir, lines

    def spread(self, src, table, times=1):
        n = -(-self.lines(table) * times // TASK_LINES) if self.lines else 0
        return f"(select /*+ repartition({n}, doc) */ * from {src})" if n > FEW_TASKS else src

    def table(self, name):
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def lit(self, s):
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\x1b", "\\u001b") + "'"

    def match(self, x, p):
        return f"({x} rlike {self.lit(java(p))})"

    def sub(self, x, p, r):
        return f"regexp_replace({x}, {self.lit(java(p))}, {self.lit(re.sub(r'\\(\d)', r'$\1', r.replace('$', chr(92) + '$')))})"

    def extract(self, x, p, g=0):
        return f"regexp_extract({x}, {self.lit(java(p))}, {g})"

    def all(self, x, p, g=0):
        return f"regexp_extract_all({x}, {self.lit(java(p))}, {g})"

    def size(self, a):
        return f"cast(size({a}) as bigint)"

    def octets(self, x):
        return f"cast(octet_length({x}) as bigint)"

    def split(self, x, c):
        return f"split({x}, {self.lit(re.escape(c) if c != chr(10) else c)})"

    def item(self, a, i):
        return f"get({a}, ({i}) - 1)"

    def last(self, a):
        return f"element_at({a}, -1)"

    def slice(self, a, lo, hi):
        """Items lo to hi, counted from 1."""
        return f"slice({a}, {lo}, greatest(({hi}) - ({lo}) + 1, 0))"

    def join(self, a, sep):
        return f"array_join({a}, {self.lit(sep)})"

    def filter(self, a, var, cond):
        return f"filter({a}, {var} -> {cond})"

    def transform(self, a, var, body):
        return f"transform({a}, {var} -> {body})"

    def explode(self, src, cols, array, pos="pos", item="line"):
        """Rows (cols, pos from 0, item) of an array column."""
        return f"(select {cols}, cast({pos} as bigint) {pos}, {item} from {src} lateral view posexplode({array}) as {pos}, {item})"

    def agg_join(self, x, order, sep):
        """Strings joined in order of a tuple of integers."""
        return f"array_join(transform(array_sort(collect_list(struct({order}, {x} as s__))), e__ -> e__.s__), {self.lit(sep)})"

    def sorted_set(self, x):
        return f"array_sort(collect_set({x}))"

    def count_if(self, c):
        return f"count_if({c})"

    def bool_or(self, c):
        return f"coalesce(bool_or({c}), false)"

    def chars(self, x):
        return f"cast(length({x}) as bigint)"

    def contains(self, x, y):
        return f"contains({x}, {y})"

    def exists(self, a, var, cond):
        return f"exists({a}, {var} -> {cond})"

    def div(self, a, b):
        return f"(({a}) div ({b}))"

    def double(self, x):
        return f"cast({x} as double)"

    def sha256(self, x):
        return f"sha2({x}, 256)"

    def epoch(self, ts):
        return f"unix_micros(cast({ts} as timestamp))"

    def numbers(self, lo, hi):
        return f"(select cast(id as bigint) n from range({lo}, {hi}))"

    def array(self, *xs):
        return f"array({', '.join(xs)})"

    def transform_at(self, a, var, at, body):
        """transform() whose body also sees where an item stands; nth() turns that into a place from 1."""
        return f"transform({a}, ({var}, {at}) -> {body})"

    def nth(self, at):
        return f"({at} + 1)"

    def upto(self, n):
        """The numbers 0 to n as an array."""
        return f"sequence(cast(0 as bigint), cast({n} as bigint))"

    def nul(self):
        return "char(0)"

    def printf(self, form, *xs):
        return f"format_string({self.lit(form)}, {', '.join(xs)})"

    def json(self, **xs):
        """A row as a JSON object."""
        return f"to_json(named_struct({', '.join(f'{self.lit(k)}, {x}' for k, x in xs.items())}))"

    def instr(self, x, s):
        return f"cast(instr({x}, {self.lit(s)}) as bigint)"

    def replace(self, x, a, b):
        return f"replace({x}, {self.lit(a)}, {self.lit(b)})"

    def lower(self, x):
        return f"lower({x})"

    def int_sum(self, x):
        return f"cast(sum({x}) as bigint)"

    def row_hash(self, *xs):
        """A 64-bit hash for comparisons inside one engine."""
        return f"xxhash64({', '.join(xs)})"

    def first_by(self, x, y):
        return f"min_by({x}, {y})"

    def last_by(self, x, y):
        return f"max_by({x}, {y})"

    def last_value(self, x, over):
        return f"last({x}, true) over ({over})"

    def first_value(self, x, over):
        return f"first({x}, true) over ({over})"

    def append(self, a, x):
        return f"array_append({a}, {x})"


class Duck(Dialect):
    name = "duckdb"

    def table(self, name):
        return name

    def lit(self, s):
        if any(ord(c) < 32 for c in s):
            parts = re.split(r"([\x00-\x1f])", s)
            return "(" + " || ".join(f"chr({ord(p)})" if len(p) == 1 and ord(p) < 32 else "'" + p.replace("'", "''") + "'" for p in parts if p) + ")"
        return "'" + s.replace("'", "''") + "'"

    def match(self, x, p):
        return f"regexp_matches({x}, {self.lit(p)})"

    def sub(self, x, p, r):
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)}, 'g')"

    def extract(self, x, p, g=0):
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def all(self, x, p, g=0):
        return f"regexp_extract_all({x}, {self.lit(p)}, {g})"

    def size(self, a):
        return f"len({a})::bigint"

    def octets(self, x):
        return f"strlen({x})::bigint"

    def split(self, x, c):
        return f"string_split({x}, {self.lit(c)})"

    def item(self, a, i):
        return f"({a})[{i}]"

    def last(self, a):
        return f"({a})[-1]"

    def slice(self, a, lo, hi):
        return f"list_slice({a}, {lo}, {hi})"

    def join(self, a, sep):
        return f"array_to_string({a}, {self.lit(sep)})"

    def filter(self, a, var, cond):
        return f"list_filter({a}, lambda {var}: {cond})"

    def transform(self, a, var, body):
        return f"list_transform({a}, lambda {var}: {body})"

    def explode(self, src, cols, array, pos="pos", item="line"):
        return f"(select {cols}, unnest(range(0, len({array})))::bigint {pos}, unnest({array}) {item} from {src})"

    def agg_join(self, x, order, sep):
        return f"string_agg({x}, {self.lit(sep)} order by {order})"

    def sorted_set(self, x):
        return f"list_sort(list(distinct {x}))"

    def count_if(self, c):
        return f"(count(*) filter (where {c}))::bigint"

    def bool_or(self, c):
        return f"coalesce(bool_or({c}), false)"

    def chars(self, x):
        return f"length({x})::bigint"

    def contains(self, x, y):
        return f"contains({x}, {y})"

    def exists(self, a, var, cond):
        return f"(len(list_filter({a}, lambda {var}: {cond})) > 0)"

    def div(self, a, b):
        return f"(({a}) // ({b}))"

    def double(self, x):
        return f"({x})::double"

    def sha256(self, x):
        return f"sha256({x})"

    def epoch(self, ts):
        return f"epoch_us({ts})"

    def numbers(self, lo, hi):
        return f"(select range::bigint n from range({lo}, {hi}))"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def transform_at(self, a, var, at, body):
        return f"list_transform({a}, lambda {var}, {at}: {body})"

    def nth(self, at):
        return at

    def upto(self, n):
        return f"range(0, ({n})::bigint + 1)"

    def nul(self):
        return "chr(0)"

    def printf(self, form, *xs):
        return f"printf({self.lit(form)}, {', '.join(xs)})"

    def json(self, **xs):
        return f"cast(to_json({{{', '.join(f'{self.lit(k)}: {x}' for k, x in xs.items())}}}) as varchar)"

    def instr(self, x, s):
        return f"instr({x}, {self.lit(s)})::bigint"

    def replace(self, x, a, b):
        return f"replace({x}, {self.lit(a)}, {self.lit(b)})"

    def lower(self, x):
        return f"lower({x})"

    def int_sum(self, x):
        return f"sum({x})::bigint"

    def row_hash(self, *xs):
        return f"hash({', '.join(xs)})"

    def first_by(self, x, y):
        return f"arg_min({x}, {y})"

    def last_by(self, x, y):
        return f"arg_max({x}, {y})"

    def last_value(self, x, over):
        return f"last_value({x} ignore nulls) over ({over})"

    def first_value(self, x, over):
        return f"first_value({x} ignore nulls) over ({over})"

    def append(self, a, x):
        return f"list_append({a}, {x})"
