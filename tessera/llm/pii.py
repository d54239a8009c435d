"""Personal data by bootstrapped contextual extraction.

1. Seeds. Base expressions find e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone
   numbers; these spans always stay.
2. Candidates. Any other token that isn't a plain word (it holds a digit, or a mark between letters) is a candidate, and so
   are neighbouring tokens of digits taken together; no shape of an identifier is given. A kind only
   rules out what it can't be (see could_be).
3. Patterns. The word before and the word after an instance are its lexical patterns.
4. Iteration. Patterns and instances are the two sides of a graph. A pattern's confidence is the share of its
   word's occurrences in all texts that stand beside a known instance of the kind; those beside candidates that could be of the kind
   don't count. An instance's score joins its patterns' confidences; instances over a threshold become known, for a few
   rounds. All counts are DataFrame aggregations over the whole table.
5. Candidates beside confident patterns become spans. One that overlaps a base span is dropped.

A pattern needs MIN_SUPPORT distinct known instances, so that chance neighbours teach nothing.

Defined results: null counts as empty text. Overlaps between kinds among base spans stay. Repeated rows, and rows that
share an id or have none, each get their own spans. An empty table gives no rows; other columns are ignored, or
returned beside the spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialize, split_batches, told

KINDS = ("email", "ip", "card", "phone")
#: Rows with learned spans that are told to every task; with more of them all rows are shuffled.
LEARNED_ROWS = 100_000
#: Distinct known instances that a pattern needs, the least confidence of a pattern that counts, of what is found, and the rounds.
MIN_SUPPORT = 5
MIN_PATTERN = 0.5
MIN_CONFIDENCE = 0.8
ROUNDS = 3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

_WHITE = "\x20\x09-\x0d"
_MARKS = r"0-9@#/\\_%=&*|~^"
#: A token with a digit, or with a mark that plain words don't have between letters.
_ODD = re.compile(rf"(?<![^{_WHITE}])(?:[^{_WHITE}{_MARKS}.:+]|[.:+](?![A-Za-z0-9]))*+(?:[{_MARKS}]|[.:+](?=[A-Za-z0-9]))[^{_WHITE}]*+")
_SPELT = re.compile(rf"(?<![^{_WHITE}])[A-Za-z0-9._%+-]++ ?[(\[{{]at[)\]}}] ?[A-Za-z0-9-]+(?: ?(?:[(\[{{]dot[)\]}}]|\.) ?[A-Za-z0-9-]+)+", re.I)
_CUE = re.compile(r"[A-Za-z][A-Za-z_-]+[:=]+(?=.)", re.S)
_NUMBERS = re.compile(r"[0-9().+/-]+")
_HEX = re.compile(r"[0-9A-Fa-f]+")
_LETTERS = re.compile(r"[A-Za-z]")
_PLAIN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0000000000")
#: Where words end, for the engine and for one text: at white space, and after a colon or equals sign.
WORD_ENDS = rf"[{_WHITE}]+|(?<=[:=])(?=[^{_WHITE}])"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ back over the local part and on over the domain; linear also in long runs."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and text[low - 1] in _LOCAL:
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((low, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; leftmost non-overlapping matches, failing ones dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and len(digits) >= 13 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = len(_DIGITS.findall(m[0])) if m.end() - m.start() < 200 else sum(c.isdigit() for c in m[0])
            if 9 <= n <= 15:
                out.append(("phone", *m.span()))
    return out


def could_be(token: str) -> list[int]:
    """The kinds that a candidate can be: what its digits and letters don't rule out."""
    digits, letters = len(_DIGITS.findall(token)), len(_LETTERS.findall(token))
    out = []
    if letters and token[-1].isalnum() and any(c in token for c in "@#*|~^$&%([{"):
        out.append(0)
    if digits and any(c in token for c in ".:-_[("):
        parts = _HEX.findall(token.replace("dot", "."))
        others = letters - sum(len(_LETTERS.findall(p)) for p in parts)
        if all(len(p) <= 4 for p in parts) and (len(parts) > 3 or "::" in token) and others <= 3 * token.count("dot"):
            out.append(1)
    if 13 <= digits <= 19 and not letters and luhn("".join(_DIGITS.findall(token))):
        out.append(2)
    if 7 <= digits <= 15 and letters <= 4 and not any(c in token for c in "@:_=%&*|~^"):
        out.append(3)
    return out


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A token's place without a cue in front, and without the marks around it."""
    if m := _CUE.match(text, a, b):
        a = m.end()
    while a < b and (text[b - 1] in ".,;:!?\"'>" or (text[b - 1] in ")]}" and not any(c in text[a:b] for c in "([{"))):
        b -= 1
    while a < b and (text[a] in "\"'<" or (text[a] in "([{" and not any(c in text[a:b] for c in ")]}"))):
        a += 1
    return a, b


def candidate_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Tokens that aren't plain words and overlap no base span, once for each kind that they can be."""
    tokens: list[list[int]] = []
    for m in _ODD.finditer(text):
        a, b = m.span()
        if tokens and a == tokens[-1][1] + 1 and text[a - 1] == " " and _NUMBERS.fullmatch(text, a, b) and _NUMBERS.fullmatch(text, tokens[-1][2], a - 1):
            tokens[-1][1:] = [b, a]  # one run of numbers
        else:
            cue = _CUE.match(text, a, b)
            tokens.append([a, b, cue.end() if cue else a])
    spans = {_trimmed(text, a, b) for a, b, _ in tokens}
    if "at" in text or "AT" in text:
        spans |= {m.span() for m in _SPELT.finditer(text)} if any(c in text for c in "([{") else set()
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = [0, *accumulate((b for _, b in taken), max)]
    out = []
    for a, b in sorted(spans):
        if a < b and reach[bisect_left(starts, b)] <= a:
            out += [(KINDS[k], a, b) for k in could_be(text[a:b])]
    return out


def before(text: str, start: int, floor: int) -> str:
    """The word that ends in front of start, brackets and quotes left out; empty if there is none or it isn't a whole word."""
    end = start
    while end > floor and text[end - 1] in "([{<\"'":
        end -= 1
    at = end
    while at > floor and text[at - 1] in " \t\n\v\f\r":
        at -= 1
    if at == floor or (at == end and text[at - 1] not in ":="):
        return ""
    low = at - 1
    while low > floor and text[low - 1] not in " \t\n\v\f\r:=":
        low -= 1
    return "" if low == floor and floor and text[floor - 1] not in " \t\n\v\f\r:=" else text[low:at].translate(_PLAIN)


def after(text: str, end: int, ceiling: int) -> str:
    """The word that begins behind end, closing marks left out; empty if there is none or it isn't a whole word."""
    at = end
    while at < ceiling and text[at] in ")]}>\"',.;!?":
        at += 1
    low = at
    while low < ceiling and text[low] in " \t\n\v\f\r":
        low += 1
    if low == at or low == ceiling:
        return ""
    high = low + 1
    while high < ceiling and text[high] not in " \t\n\v\f\r" and text[high - 1] not in ":=":
        high += 1
    return "" if high == ceiling and ceiling < len(text) and text[ceiling] not in " \t\n\v\f\r" and text[high - 1] not in ":=" else text[low:high].translate(_PLAIN)


def _scan(batches):
    import pyarrow as pa

    names = ["doc_id", "kinds", "starts", "ends", "base", "lefts", "rights", "instances", "text", "others"]
    kinds_of = pa.list_(pa.int32())
    for batch in split_batches(batches, 2_000_000):
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            more = candidate_spans(text, base) if text else []
            both = [*base, *more]
            edges = sorted({(a, b) for _, a, b in both})
            near, floor = {}, 0  # a word next to an instance reaches to the one before or after at most
            for (a, b), (ceiling, _) in zip(edges, [*edges[1:], (len(text or ""), 0)], strict=False):
                near[a, b] = before(text, a, min(floor, a)), after(text, b, max(ceiling, b))
                floor = max(floor, b)
            words = [near[a, b] for _, a, b in both]
            rows.append(([KINDS.index(k) for k, _, _ in both], [a for _, a, _ in both], [b for _, _, b in both], len(base), [x for x, _ in words], [y for _, y in words], [text[a:b] for _, a, b in both]))
        types = (kinds_of, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), *[pa.list_(pa.string())] * 3)
        columns = [batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]]
        if batch.num_columns > 2:  # the row itself goes along
            columns += [batch.column(1), batch.column(2)]
        yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])


def word_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """word, total of the wanted words in all texts (text)."""
    raw = texts.select(F.explode(F.split("text", WORD_ENDS)).alias("raw")).groupBy("raw").agg(F.count("*").alias("c"))
    plain = "".join(map(chr, sorted(_PLAIN))), "".join(chr(_PLAIN[c]) for c in sorted(_PLAIN))
    return raw.select(F.translate("raw", *plain).alias("word"), "c").join(told(wanted), "word", "left_semi").groupBy("word").agg(F.sum("c").alias("total"))


def confident_patterns(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """kind, side, word, confidence of the patterns that count, from edges (kind, side, word, instance, times, known)."""
    score = edges.groupBy("kind", "side", "word").agg(
        F.count_if("known").alias("support"), F.sum(F.when(F.col("known"), F.col("times")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("times"))).alias("open")
    )
    # beside the word: known instances, candidates that could be of the kind, and everything else
    wrong = F.greatest(F.col("total") - F.col("hits") - F.col("open"), F.lit(0))
    score = score.where(F.col("support") >= MIN_SUPPORT).join(totals, "word").withColumn("confidence", F.col("hits") / (F.col("hits") + wrong + 1.0))
    return score.where(F.col("confidence") >= MIN_PATTERN).select("kind", "side", "word", "confidence")


def either(confidence: str) -> Column:
    """Of several confidences that each may be right alone, that any of them is."""
    return 1 - F.exp(F.sum(F.log(1 - F.col(confidence))))


def bootstrap(occurrences: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Patterns learned from occurrences (row, seed, kind, start, end, left, right, instance), or None if there is nothing to learn."""
    sides = F.filter(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("word")), F.struct(F.lit(1).alias("side"), F.col("right").alias("word"))), lambda x: x["word"] != "")
    edges = occurrences.select("kind", "seed", "instance", F.explode(sides).alias("x"))
    edges = materialize(edges.groupBy("kind", F.col("x.side").alias("side"), F.col("x.word").alias("word"), "instance").agg(F.count("*").alias("times"), F.max("seed").alias("known")), "edges")
    able = edges.groupBy("kind", "side", "word").agg(F.count("*").alias("n"), F.count_if("known").alias("some")).where(F.col("n") >= MIN_SUPPORT)
    wanted = materialize(able.groupBy("word").agg(F.max("some").alias("some")), "wanted")  # words that later rounds may need, too
    if wanted.where(F.col("some") >= MIN_SUPPORT).isEmpty():
        return None
    totals = materialize(word_counts(texts, wanted), "totals")
    for step in range(ROUNDS):
        patterns = materialize(confident_patterns(edges, totals), f"patterns-{step}")
        if step == ROUNDS - 1 or patterns.isEmpty():
            break
        taught = edges.where("not known").join(told(patterns), ["kind", "side", "word"]).groupBy("kind", "instance").agg(either("confidence").alias("score"))
        taught = materialize(taught.where(F.col("score") >= MIN_CONFIDENCE).select("kind", "instance", F.lit(True).alias("new")), f"taught-{step}")
        if taught.isEmpty():
            break
        marked = edges.join(told(taught), ["kind", "instance"], "left")
        edges = materialize(marked.select("kind", "side", "word", "instance", "times", (F.col("known") | F.coalesce("new", F.lit(False))).alias("known")), f"edges-{step}")
    return patterns


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """found: array of (kind, start, end, learned) by kind, then start; with doc_id, or, if whole, with text and others (the other columns); one row for each row of df."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, kinds array<int>, starts array<long>, ends array<long>, base int, lefts array<string>, rights array<string>, instances array<string>"
    kept = ["doc_id"]
    if whole:
        docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct(*[c for c in df.columns if c != text]).alias("others"))
        schema, kept = T.StructType([*T.StructType.fromDDL(schema).fields, docs.schema["text"], docs.schema["others"]]), ["text", "others"]
    scanned = docs.mapInArrow(_scan, schema).withColumn("row", F.monotonically_increasing_id())
    scanned = materialize(scanned, "scanned")
    each = scanned.where("size(kinds) > 0").select("row", "base", F.posexplode(F.arrays_zip("kinds", "starts", "ends", "lefts", "rights", "instances")).alias("pos", "x"))
    fields = (("kinds", "kind"), ("starts", "start"), ("ends", "end"), ("lefts", "left"), ("rights", "right"), ("instances", "instance"))
    each = materialize(each.select("row", (F.col("pos") < F.col("base")).alias("seed"), *[F.col(f"x.{a}").alias(b) for a, b in fields]), "occurrences")
    base = F.transform(F.slice(F.arrays_zip("kinds", "starts", "ends"), F.lit(1), F.col("base")), lambda x: F.struct(x["kinds"].alias("kind"), x["starts"].alias("start"), x["ends"].alias("end"), F.lit(False).alias("learned")))
    rows = scanned.select("row", *kept, base.alias("found"))
    patterns = bootstrap(each, docs.select("text"))
    if patterns is None or patterns.isEmpty():
        return rows.drop("row")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("word")), F.struct(F.lit(1).alias("side"), F.col("right").alias("word"))))
    beside = each.where("not seed").select("row", "kind", "start", "end", sides.alias("x")).select("row", "kind", "start", "end", "x.side", "x.word")
    learned = beside.join(told(patterns), ["kind", "side", "word"]).groupBy("row", "kind", "start", "end").agg(either("confidence").alias("score")).where(F.col("score") >= MIN_CONFIDENCE)
    learned = materialize(learned.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", F.lit(True).alias("learned"))).alias("more")), "learned")
    rows = rows.join(told(learned, LEARNED_ROWS), "row", "left")
    return rows.select(*kept, F.array_sort(F.concat("found", F.coalesce("more", F.slice("found", 1, 0)))).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is(kind: int):
    return lambda x: x["kind"] == kind


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest, and all spans as text."""
    found = find(df, doc_id, text)
    base = F.filter("found", lambda x: ~x["learned"])
    counts = [F.size(F.filter(base, _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
