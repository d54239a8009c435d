"""Gap analyses, text and page analytics, matching, clustering inputs and vector search."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import strings as X
from ..plans.dialect import SPARK
from ..plans.registry import frame, query
from ..sources import stand_ins as T
from ..sources.scratch import small_batches

# Fixed values.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been", "it", "its", "this", "that", "these", "those", "i", "you", "he", "she",
    "we", "they", "what", "which", "who", "whom", "all", "each", "every", "no", "not", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just", "don", "should", "now", "your", "our", "my",
    "their", "his", "her", "have", "has", "had", "do", "does", "did",
)
FORMATS = {
    "faq": ("faq", "frequently asked", "questions and answers", "q&a"),
    "how_to": ("how to", "step by step", "guide", "tutorial", "steps to"),
    "listicle": ("top 10", "top 5", "best", "list of", "ways to"),
    "comparison": ("vs", "versus", "comparison", "compare", "difference"),
    "review": ("review", "reviewed", "rating", "pros and cons"),
    "case_study": ("case study", "success story", "example", "real-world"),
}
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Jr.", "Sr.", "Inc.", "Ltd.", "Corp.", "Co.", "vs.", "etc.", "e.g.", "i.e.", "a.m.", "p.m.", "A.M.", "P.M.", "U.S.", "U.K.", "U.N.")
SYLLABLES = {
    "area": 3, "idea": 3, "real": 2, "ruin": 2, "science": 2, "create": 2, "creature": 2, "feature": 2, "measure": 2, "employee": 3, "every": 3, "evening": 3, "everything": 4, "business": 2, "different": 3,
    "family": 3, "interest": 3, "favorite": 3, "separate": 3, "chocolate": 3, "comfortable": 4, "temperature": 4, "vegetable": 4, "literature": 4, "dictionary": 4,
}


def rankings_of(d) -> str:
    """Keyword, competitor, position: users as keywords, event types as competitors, the latest value."""
    return f"SELECT keyword, domain AS competitor, max_by(position, seq) AS position FROM ({T.rankings(d)}) r GROUP BY keyword, domain"


def _gaps(d, own: str) -> str:
    return f""" r AS ({rankings_of(d)}), mine AS (SELECT keyword, position FROM r WHERE competitor = '{own}'),
c AS (SELECT keyword, count(*) AS n, avg(position) AS average, min(position) AS best FROM r WHERE competitor <> '{own}' GROUP BY keyword), t AS (SELECT count(DISTINCT competitor) AS total FROM r WHERE competitor <> '{own}'),
g AS (SELECT c.keyword, mine.position AS own, c.n, c.average, c.best, t.total, c.keyword * 7 % 2000 AS volume FROM c LEFT JOIN mine ON c.keyword = mine.keyword CROSS JOIN t WHERE mine.position IS NULL OR mine.position > c.average + 5),
s AS (SELECT *, {S.gap_score('own', 'average', 'n', 'total', 'volume')} AS score, {S.gap_category('own', 'average')} AS category FROM g), p AS (SELECT *, {S.gap_priority('score', 'category', 'n * 1e0 / greatest(1, total)')} AS priority FROM s)
"""


@query("keyword_gaps", "G1 J30 R6 R7 R8")
def keyword_gaps(d, own: str = "view"):
    """Keywords that competitors hold and we miss or trail by over five places, scored and classed."""
    return f"""WITH {_gaps(d, own)}SELECT keyword, own, n AS competitors, round(average, 6) AS average, best, round(score, 2) AS score, category, priority, average > 5 OR priority IN ('critical', 'high') AS quick_win FROM p"""


@query("keyword_plan", "R9")
def keyword_plan(d, own: str = "view", most: int = 20):
    """The gaps to go for first: by priority, then by score."""
    return f"""WITH {_gaps(d, own)}SELECT keyword, category, priority, round(score, 2) AS score FROM p ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, round(score, 2) DESC, keyword LIMIT {most}"""


@query("keyword_list_gaps", "R10")
def keyword_list_gaps(d, own: str = "view"):
    """Without positions: a competitor's keyword is a gap if it isn't among ours, those we hold within fifty places."""
    return f"WITH r AS ({rankings_of(d)}) SELECT keyword, count(*) AS competitors FROM r WHERE competitor <> '{own}' AND keyword NOT IN (SELECT keyword FROM r WHERE competitor = '{own}' AND position <= 50) GROUP BY keyword"


@query("backlink_gaps", "G2 R48")
def backlink_gaps(d):
    """Domains that link to competitors and not to us, with coverage."""
    return f"""WITH p AS ({T.results(d)}), l AS (SELECT DISTINCT source_domain, domain FROM p WHERE source_domain IS NOT NULL), ours AS (SELECT source_domain FROM l WHERE domain = 'd7.com')
SELECT l.source_domain, count(DISTINCT l.domain) AS competitors, {S.link_type(d, 'l.source_domain')} AS kind FROM l LEFT JOIN ours ON l.source_domain = ours.source_domain WHERE ours.source_domain IS NULL AND l.domain <> 'd7.com' GROUP BY l.source_domain"""


def words_of(d, text: str) -> str:
    return d.keep(d.find_all(f"lower({text})", "[a-z]+"), lambda e: f"length({e}) > 2 AND {e} NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})")


@query("content_gaps", "G3 G4 R15 R16")
def content_gaps(d):
    """Words of two sources at least that source src0 lacks, by coverage; the first hundred."""
    return f"""WITH w AS (SELECT source, {d.unnest(d.distinct(words_of(d, 'text')))} AS topic FROM documents), c AS (SELECT topic, count(DISTINCT source) AS sources, count(*) AS pages FROM w WHERE source <> 'src0' GROUP BY topic),
ours AS (SELECT DISTINCT topic FROM w WHERE source = 'src0') SELECT c.topic, c.sources, c.pages FROM c LEFT JOIN ours ON c.topic = ours.topic WHERE ours.topic IS NULL AND c.sources >= 2 ORDER BY c.sources DESC, c.pages DESC, c.topic LIMIT 100"""


@query("topic_terms", "L18")
def topic_terms(d):
    """Each source's most frequent words, with their weight."""
    return f"""WITH w AS (SELECT source, {d.unnest(words_of(d, 'text'))} AS term FROM documents), c AS (SELECT source, term, count(*) AS n FROM w GROUP BY source, term),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM c) SELECT source, term, n, rank FROM r WHERE rank <= 20"""


@query("topic_coverage", "L19 L20 R17")
def topic_coverage(d):
    kinds = ", ".join(f"{d.contains_any('t', words)} AS {name}" for name, words in FORMATS.items())
    return f"""WITH p AS (SELECT page_id, lower(html) AS t, html FROM pages) SELECT page_id, least(100, 10 * {d.count('t', 'the')} + 20 * {d.count('t', '<h[1-6][^>]*>[^<]*the')}) AS coverage, {kinds}, {d.count('html', '(?i)<h[1-6][^>]*>[^<]+</h[1-6]>')} AS headings FROM p"""


def syllables(d, w: str, groups: str) -> str:
    """Vowel groups, less silent endings, at least one; a few words by table. w: in lower case, without marks at its ends."""
    ends = lambda *s: " OR ".join(d.ends(w, x) for x in s)
    e = f"CASE WHEN {groups} > 1 AND {ends('e')} AND NOT ({ends('le')}) THEN 1 ELSE 0 END"
    ed = f"CASE WHEN {groups} > 1 AND {ends('ed')} AND NOT ({ends('ted', 'ded')}) THEN 1 ELSE 0 END"
    es = f"CASE WHEN {groups} > 1 AND {ends('es')} AND NOT ({ends('ses', 'xes', 'zes', 'ches', 'shes')}) THEN 1 ELSE 0 END"
    return d.lookup(w, SYLLABLES, f"greatest(1, {groups} - {e} - {ed} - {es})")


def _grades(d, counts: str) -> str:
    """Grades from doc_id, s (sentences), words, chars, syllables, complex_words."""
    level = S.tiers("grade", ((5, "'Elementary'"), (8, "'Middle School'"), (12, "'High School'"), (16, "'College'")), "'Graduate'", "<=")
    return f"""WITH m AS ({counts}), g AS (SELECT *, greatest(0e0, 0.39e0 * words / s + 11.8e0 * syllables / words - 15.59e0) AS grade FROM m WHERE s > 0 AND words > 0)
SELECT doc_id, s AS sentences, words, syllables, complex_words, round(grade, 6) AS fk_grade, round(greatest(0e0, least(100e0, 206.835e0 - 1.015e0 * words / s - 84.6e0 * syllables / words)), 6) AS reading_ease,
  round(0.4e0 * (words * 1e0 / s + 100e0 * complex_words / words), 6) AS fog, CASE WHEN s >= 30 THEN round(1.043e0 * sqrt(complex_words * 30e0 / s) + 3.1291e0, 6) END AS smog, round(greatest(0e0, 5.88e0 * chars / words - 29.6e0 * s / words - 15.8e0), 6) AS coleman_liau,
  round(greatest(0e0, 4.71e0 * chars / words + 0.5e0 * words / s - 21.43e0), 6) AS ari, {level} AS level, words / 200e0 AS minutes FROM g"""


def sentences(d, ahead: str = "") -> str:
    """How many; ahead: what an engine that can look ahead tests first."""
    short = "|".join(re.escape(a[:-1]) for a in ABBREVIATIONS)
    return d.size(d.keep(d.split(d.sub(d.sub("text", rf"{ahead}({short})\.", "{1}~"), r"[.!?]+\s+", "|"), "|"), lambda e: f"trim({e}) <> ''"))


#: The first two characters of an abbreviation are of these: few places in a text are tried against all of them.
MAYBE_SHORT = "(?=" + "".join(f"[{''.join(sorted({a[k] for a in ABBREVIATIONS}))}]" for k in (0, 1)) + ")"


def _readability_sql(d) -> str:
    """A list of words, each with its own syllables."""
    words = d.keep(d.split(d.sub(d.sub("text", r"[^A-Za-z0-9_\s'-]", " "), r"\s+", " "), " "), lambda e: f"length({e}) > 1 AND NOT {d.match(e, '^[0-9]+$')}")
    counted = d.each("words", lambda e: d.struct(w=f"lower({e})", g=d.count(f"lower({e})", "[aeiouy]+")))
    return _grades(d, f"""SELECT doc_id, s, size_ AS words, chars, {d.total('each_word')} AS syllables, {d.size(d.keep('each_word', lambda e: f'{e} >= 3'))} AS complex_words FROM (
  SELECT doc_id, s, {d.size('counted')} AS size_, {d.each('counted', lambda e: syllables(d, f'{e}.w', f'{e}.g'))} AS each_word, {d.total(d.each('counted', lambda e: f'length({e}.w)'))} AS chars FROM (
    SELECT doc_id, s, {counted} AS counted FROM (SELECT doc_id, {sentences(d)} AS s, {words} AS words FROM documents WHERE text IS NOT NULL) t) c) y""")


class WordCounts(dict):
    """Of each word as written: whether it counts, its characters, syllables and whether it is complex, as four numbers of BITS bits in one, so that a text's words add up in one sum."""

    BITS, MOST = 32, 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        n = 0 if word.isdigit() else word_syllables(word.lower())
        self[word] = found = n and 1 + (len(word) << self.BITS) + (n << 2 * self.BITS) + ((n >= 3) << 3 * self.BITS)
        return found

    def of(self, text: str) -> list[int]:
        # words of one character don't count
        total = sum(map(self.__getitem__, re.findall("[A-Za-z0-9_'-]{2,}", text)))
        return [total >> k * self.BITS & (1 << self.BITS) - 1 for k in range(4)]


def word_syllables(word: str) -> int:
    """What syllables says, of a word in lower case."""
    groups = len(re.findall("[aeiouy]+", word))
    silent = groups > 1 and (word.endswith("e") and not word.endswith("le")) + (word.endswith("ed") and not word.endswith(("ted", "ded"))) + (word.endswith("es") and not word.endswith(("ses", "xes", "zes", "ches", "shes")))
    return SYLLABLES.get(word, max(1, groups - silent))


def _counted(batches):
    import pyarrow as pa

    known = WordCounts()
    for batch in batches:
        ids, texts, s = batch.columns
        words, chars, spoken, hard = zip(*map(known.of, texts.to_pylist()), strict=True) if batch.num_rows else ((),) * 4
        columns = [ids, s, pa.array(words, pa.int32()), pa.array(chars, pa.int32()), pa.array(spoken, pa.int64()), pa.array(hard, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "s", "words", "chars", "syllables", "complex_words"])


@frame("readability", "L14 L15 L16 L17 D9 D22", _readability_sql)
def readability(spark, sf_dir):
    """Grades of texts; complex words have three syllables or more.

    Sentences are counted by an expression. Words go through one look-up each: a word's counts are worked out when a task first meets it.
    """
    small_batches(spark)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text", F.expr(sentences(SPARK, MAYBE_SHORT)).alias("s"))
    counted = (("words", "int"), ("chars", "int"), ("syllables", "bigint"), ("complex_words", "int"))
    schema = texts.select("doc_id", "s", *(F.lit(0).cast(t).alias(n) for n, t in counted)).schema
    return spark.sql(_grades(SPARK, "SELECT * FROM {counts}"), counts=texts.mapInArrow(_counted, schema))


@query("engagement", "J32 R32 R33 R34")
def engagement(d):
    """Depth, interactivity, visual appeal, navigation, structure; level, bounce risk and time on page."""
    n = {"paragraphs": "(?i)<p[^>]*>", "headings": "(?i)<h[1-6][^>]*>", "images": "(?i)<img[^>]*>", "videos": "(?i)<(?:video|iframe)[^>]*(?:youtube|vimeo|video)[^>]*>", "links": "(?i)<a[^>]*href=[\"'][^\"']*[\"']", "outside": "(?i)<a[^>]*href=[\"']http[^\"']*[\"']", "forms": "(?i)<form[^>]*>", "lists": "(?i)<(?:ul|ol)[^>]*>", "tables": "(?i)<table[^>]*>", "code": "(?i)<(?:pre|code)[^>]*>"}
    text = X.squeeze(d, d.sub("html", "(?s)<[^>]*>", " "))
    depth = """least(100e0, CASE WHEN words >= 1500 THEN 40e0 WHEN words >= 300 THEN 40e0 * (words - 300) / 1200 ELSE 20e0 * words / 300 END + CASE WHEN headings >= 8 THEN 20e0 WHEN headings >= 3 THEN 20e0 * (headings - 3) / 5 ELSE 10e0 * headings / 3 END
      + CASE WHEN paragraphs >= 15 THEN 20e0 WHEN paragraphs >= 5 THEN 20e0 * (paragraphs - 5) / 10 ELSE 0e0 END + least(5, lists * 2) + least(5, tables * 2) + least(5, code * 2) + least(5, images))"""
    inter = "least(100e0, least(25, forms * 15) + least(20, videos * 10) + CASE WHEN inside >= 5 THEN 15 ELSE inside * 3 END + CASE WHEN outside >= 3 THEN 10 ELSE outside * 3 END)"
    visual = "least(100e0, CASE WHEN images >= 5 THEN 50 WHEN images >= 1 THEN 20 + images * 6 ELSE 0 END + least(30, videos * 15) + least(7, lists * 2) + least(7, tables * 3) + CASE WHEN headings >= 3 THEN least(6, headings) ELSE 0 END)"
    read = "50 + CASE WHEN paragraphs >= 5 THEN 20 ELSE 0 END + CASE WHEN headings >= 3 THEN 15 ELSE 0 END + CASE WHEN lists > 0 THEN 15 ELSE 0 END"
    risk = "greatest(0.1e0, least(0.9e0, 0.6e0 + CASE WHEN words < 300 THEN 0.2e0 ELSE 0e0 END + CASE WHEN images = 0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN words > 3000 THEN 0.1e0 ELSE 0e0 END - CASE WHEN depth > 70 THEN 0.2e0 WHEN depth > 50 THEN 0.1e0 ELSE 0e0 END - CASE WHEN inter > 60 THEN 0.15e0 WHEN inter > 40 THEN 0.1e0 ELSE 0e0 END - CASE WHEN videos > 0 THEN 0.15e0 ELSE 0e0 END))"
    level = S.tiers("score", ((80, "'excellent'"), (65, "'good'"), (45, "'average'"), (25, "'poor'")), "'very_poor'")
    kind = "CASE WHEN contains(u, '/blog/') OR contains(u, '/post/') OR contains(u, '/article/') THEN 'blog' WHEN contains(u, '/product/') OR contains(u, '/shop/') THEN 'product' WHEN contains(u, '/service') THEN 'service' WHEN contains(u, '/tool') OR contains(u, '/calculator') THEN 'tool' WHEN forms > 0 AND words < 500 THEN 'landing' WHEN words > 1000 AND headings >= 3 THEN 'article' WHEN words > 500 THEN 'blog' ELSE 'unknown' END"
    return f"""WITH s AS (SELECT page_id, lower(url) AS u, {d.size(d.split(text, ' '))} AS words, {', '.join(f'{d.count("html", p)} AS {k}' for k, p in n.items())} FROM pages), i AS (SELECT *, links - outside AS inside FROM s),
c AS (SELECT *, {depth} AS depth, {inter} AS inter, {visual} AS visual, {read} AS structure, {kind} AS kind FROM i), e AS (SELECT *, depth * 0.30e0 + inter * 0.20e0 + visual * 0.15e0 + least(100, inside * 10) * 0.15e0 + least(100, structure) * 0.10e0 + 5e0 AS score, {risk} AS risk FROM c)
SELECT page_id, kind, words, round(depth, 6) AS depth, round(inter, 6) AS inter, round(visual, 6) AS visual, round(score, 6) AS score, {level} AS level, round(risk, 6) AS risk, round(greatest(10e0, least(600e0, (words / 200e0 * 36 + videos * 60 + forms * 30) * (1 - risk * 0.5e0))), 6) AS seconds FROM e"""


@query("page_text", "L8 R36 L5 L13 R44 L3 L4")
def page_text(d):
    """Title, main text, its words, links by class and page type, from stored HTML."""
    body = d.sub(d.sub("html", "(?is)<(script|style|nav|header|footer)[^>]*>.*?</(script|style|nav|header|footer)>", " "), "(?is)<!--.*?-->", " ")
    text = X.squeeze(d, d.sub(body, "(?s)<[^>]*>", " "))
    kind = f"CASE WHEN {d.match('lower(url)', '/(blog|post|news)')} THEN 'blog' WHEN {d.match('lower(url)', '/(contact|about)')} THEN 'about' WHEN {d.match('url', '://[^/]*/?$')} THEN 'home' ELSE 'page' END"
    words = d.keep(d.find_all("lower(main)", "[a-z]+"), lambda e: f"length({e}) > 2")
    return f"""WITH p AS (SELECT page_id, url, html, {text} AS main FROM pages) SELECT page_id, {d.find('html', '(?is)<title[^>]*>(.*?)</title>', 1)} AS title, length(main) AS main_chars, {d.size(words)} AS words, {d.size(d.distinct(words))} AS unique_words,
  {d.count('html', '(?i)<a[^>]*href=["' + "']/")} AS inside_links, {d.count('html', 'tel:[+0-9]')} AS phones, {d.count('html', 'mailto:')} AS mails, {kind} AS kind FROM p"""


@query("page_sections", "L11")
def page_sections(d):
    """Parts of a page between second-level headings, at most two thousand characters of text each."""
    parts = d.split(d.sub("html", "(?i)<h2[^>]*>", "\u0001"), "\u0001")
    return f"WITH s AS (SELECT page_id, {d.unnest(parts)} AS part FROM pages) SELECT page_id, substr({X.squeeze(d, d.sub('part', '(?s)<[^>]*>', ' '))}, 1, 2000) AS content FROM s"


@query("similar_vectors", "N1 N2")
def similar_vectors(d, of: int = 7, label: int = 3, limit: int = 10):
    """Nearest by cosine to one vector among those of a label."""
    return f"""WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = {of}) SELECT e.vec_id, e.label, round({d.cosine('e.embedding', 'q.qv')}, 6) AS cosine FROM embeddings e CROSS JOIN q WHERE e.vec_id <> {of} AND e.label = {label} ORDER BY {d.cosine('e.embedding', 'q.qv')} DESC, e.vec_id LIMIT {limit}"""


@query("vectors_deleted", "N3 A21")
def vectors_deleted(d):
    """Points left after those of some keys are deleted, the last write of each id."""
    return "SELECT label, count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY label"


@query("text_chunks", "N4")
def text_chunks(d, size: int = 4000, step: int = 3200):
    """Pieces of four thousand characters that overlap by eight hundred."""
    return f"""WITH t AS (SELECT doc_id, text, {d.unnest(d.series('0', 'greatest(0, length(text) - 1)', str(step)))} AS low FROM documents) SELECT doc_id, CAST(low AS bigint) AS low, length(substr(text, CAST(low AS int) + 1, {size})) AS n, {d.sha(f'substr(text, CAST(low AS int) + 1, {size})')} AS hash FROM t"""


@query("features", "N6 R68")
def features(d):
    """Numeric features of each company for a classifier."""
    return f"WITH c AS ({T.companies(d)}) SELECT id, coalesce(reviews, 0) AS reviews, CASE WHEN phone IS NULL THEN 0 ELSE 1 END AS has_phone, CASE WHEN street IS NULL THEN 0 ELSE 1 END AS has_street, CASE WHEN website IS NULL THEN 0 ELSE 1 END AS has_site, length(trim(name)) AS name_length, quality_score / 100e0 AS score FROM c"


@query("serp_competitors", "R50 R65")
def serp_competitors(d):
    """Domains in the first ten places beside ours, by the number of shared searches; the top five."""
    return f"""WITH p AS ({T.results(d)}), s AS ({T.snapshots(d)}), q AS (SELECT DISTINCT s.query_id, p.domain FROM p JOIN s ON p.snapshot_id = s.snapshot_id WHERE p.position <= 10), ours AS (SELECT query_id FROM q WHERE domain = 'd7.com')
SELECT q.domain, count(*) AS shared FROM q JOIN ours ON q.query_id = ours.query_id WHERE q.domain <> 'd7.com' GROUP BY q.domain ORDER BY shared DESC, q.domain LIMIT 5"""


@query("domain_duel", "R51")
def domain_duel(d):
    """Two domains' best places over all searches of either: wins, ties, only one."""
    return f"""WITH p AS ({T.results(d)}), s AS ({T.snapshots(d)}), b AS (SELECT s.query_id, p.domain, min(p.position) AS position FROM p JOIN s ON p.snapshot_id = s.snapshot_id WHERE p.domain IN ('d7.com', 'd8.com') GROUP BY s.query_id, p.domain),
x AS (SELECT query_id, position FROM b WHERE domain = 'd7.com'), y AS (SELECT query_id, position FROM b WHERE domain = 'd8.com')
SELECT coalesce(x.query_id, y.query_id) AS query_id, x.position AS position_a, y.position AS position_b, CASE WHEN y.position IS NULL THEN 'only_a' WHEN x.position IS NULL THEN 'only_b' WHEN x.position < y.position THEN 'a' WHEN x.position > y.position THEN 'b' ELSE 'tie' END AS winner FROM x FULL OUTER JOIN y ON x.query_id = y.query_id"""


@query("action_plan", "R52 R31 R64")
def action_plan(d):
    """Capped lists of each kind side by side: the first ten of each, then their places."""
    return f"""WITH p AS ({T.results(d)}), k AS ({T.keywords(d)}), l AS (SELECT source_domain AS item, count(*) AS n FROM p WHERE source_domain IS NOT NULL GROUP BY source_domain), a AS (SELECT item, n, CAST(0 AS bigint) AS id FROM l ORDER BY n DESC, item LIMIT 10),
b AS (SELECT keyword AS item, CAST(volume AS bigint) AS n, id FROM k ORDER BY volume DESC, id LIMIT 10), u AS (SELECT 'backlink' AS kind, item, n, id FROM a UNION ALL SELECT 'keyword' AS kind, item, n, id FROM b)
SELECT kind, item, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, id, item) AS r FROM u"""


@query("suggestions", "R54 K6")
def suggestions(d):
    """Keys and values of stored JSON objects."""
    return f"SELECT {d.json('props', '$.k')} AS value, count(*) AS n FROM events GROUP BY 1"


@query("job_history", "R57 A6 A7")
def job_history(d):
    return f"WITH t AS ({T.task_logs(d)}) SELECT task_id, task_name, status, started_at FROM t WHERE task_name = 'purchase' AND error LIKE '%3%' ORDER BY started_at DESC, task_id LIMIT 100"


@query("labels_merged", "R63")
def labels_merged(d):
    return "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL"


@query("chat_export", "A10 A11 A12")
def chat_export(d):
    """Conversations as one line each, turns in order."""
    return f"SELECT conv_id, count(*) AS turns, {d.sha(d.list_of("role || ':' || text", 'turn'))} AS digest FROM conversations GROUP BY conv_id"
