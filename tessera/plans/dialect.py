"""SQL text for two engines from one definition.

An operator is written once, as SQL with the handful of functions whose names differ taken from a
Dialect. SPARK text runs as spark.sql(...), with all of Catalyst's pushdown and pruning; ANSI text is what a
second engine runs to check the rows.
"""

from __future__ import annotations

import re


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


class Dialect:
    name = ""

    def n_distinct(self, x: str) -> str:
        """How many distinct non-null values a small group has."""
        return f"count(DISTINCT {x})"

    def dealt(self, key: str) -> str:
        """After SELECT: rows are dealt out by key as they are, and what is grouped by it stays where it is."""
        return ""

    def edges(self, x: str, over: str) -> str:
        """Further columns of a window that deviation needs."""
        return ""

    def deviation(self, x: str, order: str) -> str:
        """The population's standard deviation of whole numbers in a group, of rows that edges has marked; order: a unique key, by which rounding may differ."""
        return f"stddev_pop({x})"

    def contains_any(self, x: str, words) -> str:
        return "(" + " OR ".join(f"contains({x}, {self.lit(w)})" for w in words) + ")"

    def first_hit(self, x: str, pairs, other: str = "NULL") -> str:
        """The value of the first of pairs (word, SQL value) whose word x contains."""
        return "CASE " + " ".join(f"WHEN contains({x}, {self.lit(w)}) THEN {v}" for w, v in pairs) + f" ELSE {other} END"

    def hits(self, x: str, words) -> str:
        """How many of the words x contains."""
        return "(" + " + ".join(f"CASE WHEN contains({x}, {self.lit(w)}) THEN 1 ELSE 0 END" for w in words) + ")"

    def lookup(self, x: str, table: dict, other: str) -> str:
        return f"CASE {x} " + " ".join(f"WHEN {self.lit(k) if isinstance(k, str) else k} THEN {v}" for k, v in table.items()) + f" ELSE {other} END"

    def lit(self, word: str) -> str:
        return text(word)


class Spark(Dialect):
    name = "spark"

    def lit(self, word: str) -> str:
        return "r" + text(word) if "\\" in word else text(word)

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(re.sub(r'\{(\d)\}', r'$\1', by))})"

    def find(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def match(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.lit(pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, {self.lit(pattern)})"

    def find_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def join(self, x: str, sep: str) -> str:
        return f"array_join({x}, {text(sep)})"

    def sort(self, x: str) -> str:
        return f"sort_array({x})"

    def distinct(self, x: str) -> str:
        return f"array_distinct({x})"

    def keep(self, x: str, condition) -> str:
        return f"filter({x}, e -> {condition('e')})"

    def each(self, x: str, value) -> str:
        return f"transform({x}, e -> {value('e')})"

    def struct(self, **fields: str) -> str:
        return f"named_struct({', '.join(f'{text(k)}, {v}' for k, v in fields.items())})"

    def total(self, x: str) -> str:
        """The sum of an array of whole numbers."""
        return f"aggregate({x}, CAST(0 AS bigint), (s, e) -> s + e)"

    def size(self, x: str) -> str:
        return f"size({x})"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(re.escape(sep))})"

    def n_distinct(self, x: str) -> str:
        # several counts of distinct values would write each row once for each of them
        return f"CAST(size(collect_set({x})) AS bigint)"

    def dealt(self, key: str) -> str:
        return f"/*+ REPARTITION({key}) */ "

    def edges(self, x: str, over: str) -> str:
        # n times the sum of squares less the square of the sum: exact, or null where it would not fit
        n, total, squares = (f"{f} OVER ({over})" for f in (f"count({x})", f"sum({x})", f"try_sum({x} * {x})"))
        spread = f"try_subtract(try_multiply({n}, {squares}), try_multiply({total}, {total}))"
        return f", sqrt(CAST({spread} AS double)) / nullif({n}, 0) AS exact"

    def deviation(self, x: str, order: str) -> str:
        """Rounding may put a whole number to either side, and so across a limit: these are added up value by value, as the second engine does."""
        edge = f"CASE WHEN exact > 0 AND exact = floor(exact) AND {x} IS NOT NULL THEN struct({order} AS o, CAST({x} AS double) AS x) END"
        mean = "(a.mean + (e.x - a.mean) / (a.n + 1e0))"
        step = f"named_struct('n', a.n + 1e0, 'mean', {mean}, 'squares', a.squares + (e.x - {mean}) * (e.x - a.mean))"
        folded = f"aggregate(sort_array(collect_list({edge})), named_struct('n', 0e0, 'mean', 0e0, 'squares', 0e0), (a, e) -> {step}, a -> sqrt(a.squares / nullif(a.n, 0e0)))"
        return f"coalesce({folded}, stddev_pop({x}))"

    def set_of(self, x: str, where: str = "true") -> str:
        """Distinct non-null values of a group, sorted, comma-joined."""
        return f"array_join(sort_array(collect_set(CASE WHEN {where} THEN {x} END)), ',')"

    def list_of(self, x: str, order: str) -> str:
        """Values of a group in the order of a unique key, comma-joined."""
        return f"array_join(transform(sort_array(collect_list(struct({order} AS o, {x} AS v))), e -> e.v), ',')"

    def unnest(self, x: str) -> str:
        return f"explode({x})"

    def starts(self, x: str, y: str) -> str:
        return f"startswith({x}, {self.lit(y)})"

    def ends(self, x: str, y: str) -> str:
        return f"endswith({x}, {self.lit(y)})"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '{path}')"

    def epoch(self, x: str) -> str:
        return f"unix_timestamp(CAST({x} AS timestamp))"

    def day(self, x: str) -> str:
        return f"CAST(date_format({x}, 'yyyyMMdd') AS int)"

    def minute(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM-dd HH:mm')"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def log1p(self, x: str) -> str:
        return f"log1p({x})"

    def form(self, x: str) -> str:
        """Form encoding, blanks as +."""
        return f"url_encode({x})"

    def cosine(self, x: str, y: str) -> str:
        dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> CAST(p AS double) * CAST(q AS double)), 0e0, (s, e) -> s + e)"
        return f"({dot(x, y)} / (sqrt({dot(x, x)}) * sqrt({dot(y, y)})))"

    def round6(self, x: str) -> str:
        """Six places, by way of whole millionths: what round(x, 6) of the second engine does, where halves in decimal aren't halves in binary."""
        return f"(round(({x}) * 1e6) / 1e6)"

    def trunc(self, x: str) -> str:
        return f"CAST({x} AS bigint)"

    def series(self, low: str, high: str, step: str) -> str:
        return f"sequence({low}, {high}, {step})"


class Ansi(Dialect):
    name = "duckdb"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {text(pattern)}, {text(re.sub(r'\{(\d)\}', lambda m: chr(92) + m[1], by))}, 'g')"

    def find(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {text(pattern)}, {group})"

    def match(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {text(pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, {text(pattern)})) AS INTEGER)"

    def find_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {text(pattern)}, {group})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def join(self, x: str, sep: str) -> str:
        return f"array_to_string({x}, {text(sep)})"

    def sort(self, x: str) -> str:
        return f"list_sort({x})"

    def distinct(self, x: str) -> str:
        return f"list_distinct({x})"

    def keep(self, x: str, condition) -> str:
        return f"list_filter({x}, lambda e: {condition('e')})"

    def each(self, x: str, value) -> str:
        return f"list_transform({x}, lambda e: {value('e')})"

    def struct(self, **fields: str) -> str:
        return f"struct_pack({', '.join(f'{k} := {v}' for k, v in fields.items())})"

    def total(self, x: str) -> str:
        return f"coalesce(CAST(list_sum({x}) AS BIGINT), 0)"

    def size(self, x: str) -> str:
        return f"CAST(len({x}) AS INTEGER)"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {text(sep)})"

    def set_of(self, x: str, where: str = "true") -> str:
        return f"coalesce(array_to_string(list_sort(list_distinct(list({x}) FILTER (WHERE {x} IS NOT NULL AND ({where})))), ','), '')"

    def list_of(self, x: str, order: str) -> str:
        return f"array_to_string(list({x} ORDER BY {order}), ',')"

    def unnest(self, x: str) -> str:
        return f"unnest({x})"

    def starts(self, x: str, y: str) -> str:
        return f"starts_with({x}, {text(y)})"

    def ends(self, x: str, y: str) -> str:
        return f"ends_with({x}, {text(y)})"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '{path}')"

    def epoch(self, x: str) -> str:
        return f"CAST(floor(epoch({x})) AS BIGINT)"

    def day(self, x: str) -> str:
        return f"CAST(strftime({x}, '%Y%m%d') AS INTEGER)"

    def minute(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m-%d %H:%M')"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def log1p(self, x: str) -> str:
        return f"ln(1e0 + {x})"

    def form(self, x: str) -> str:
        return f"replace(url_encode({x}), '%20', '+')"

    def cosine(self, x: str, y: str) -> str:
        wide = lambda a: f"list_transform({a}, lambda e: CAST(e AS DOUBLE))"
        return f"list_cosine_similarity({wide(x)}, {wide(y)})"

    def round6(self, x: str) -> str:
        return f"round({x}, 6)"

    def trunc(self, x: str) -> str:
        return f"CAST(trunc({x}) AS BIGINT)"

    def series(self, low: str, high: str, step: str) -> str:
        return f"generate_series({low}, {high}, {step})"


SPARK, ANSI = Spark(), Ansi()
