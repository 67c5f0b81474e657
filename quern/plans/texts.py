"""Normal forms, copies, near copies and quotes of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.runs import COPY_SHARE
from ..operators import naming, phrases, quotes, reposts
from ..storage import saved
from .registry import Tables, query

_SQUASH = r"regexp_replace({}, '[\s\p{{Z}}\x1c-\x1f\x85]', '', 'g')"
_BODY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', '\n', 'g'), '[ \t\x0b\f\x1c-\x1f\x85\p{{Z}}]+(\n|$)', '\1', 'g'), '\n{{3,}}', E'\n\n', 'g'), '^\n+|\n+$', '', 'g')"


@query(f"SELECT doc_id, sha256({_BODY.format('text')}) AS body_sha256, length({_BODY.format('text')}) AS body_chars FROM documents".replace("'\\n'", "chr(10)").replace("E'\\n\\n'", "chr(10) || chr(10)"))
def dd01_normal_body(t: Tables) -> DataFrame:
    body = T.normal_body(F.col("text"))
    return t.documents.select("doc_id", F.sha2(body, 256).alias("body_sha256"), F.length(body).cast("long").alias("body_chars"))


@query(f"SELECT doc_id, sha256({_SQUASH.format('text')}) AS content_sha256 FROM documents")
def dd03_content_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.fingerprint(F.col("text")).alias("content_sha256"))


@query(f"WITH f AS (SELECT doc_id, sha256({_SQUASH.format('text')}) AS h FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS original, doc_id > min(doc_id) OVER (PARTITION BY h) AS copy FROM f")
def dd04_exact_copies(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", T.fingerprint(F.col("text")).alias("h"))
    firsts = rows.groupBy("h").agg(F.min("doc_id").alias("original"))
    return rows.join(firsts, "h").select("doc_id", "original", (F.col("doc_id") > F.col("original")).alias("copy"))


_MARKS = "' ' || chr(9) || chr(13) || chr(10) || '　，。、；：！？“”‘’（）《》〈〉【】…—～·,.;:!?\"''()[]<>-'"
_KEYS = f"SELECT DISTINCT doc_id AS doc, translate(lang || '|' || line, {_MARKS}, '') AS key FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''"


def _lines(t: Tables) -> DataFrame:
    """doc and key of the lines of a document, each with its subject, without marks."""
    lines = t.documents.select(F.col("doc_id").alias("doc"), "lang", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    return lines.select("doc", T.without(F.concat("lang", F.lit("|"), "line"), T.LOOSE).alias("key"))


def _conclusions(t: Tables) -> DataFrame:
    """The conclusions of a document: its lines, each once."""
    return _lines(t).distinct()


@query(f"SELECT doc, key, length(key) AS key_chars FROM ({_KEYS})")
def dd11_conclusion_keys(t: Tables) -> DataFrame:
    return _conclusions(t).select("doc", "key", F.length("key").cast("long").alias("key_chars"))


@query(f"SELECT doc, count(*) AS n_keys, sha256(string_agg(key, chr(10) ORDER BY key)) AS profile FROM ({_KEYS}) GROUP BY 1")
def dd12_conclusion_profiles(t: Tables) -> DataFrame:
    profile = F.sha2(F.array_join(F.sort_array(F.collect_set("key")), "\n"), 256)
    return _conclusions(t).groupBy("doc").agg(F.count(F.lit(1)).alias("n_keys"), profile.alias("profile"))


@query(
    f"""WITH k AS ({_KEYS}), n AS (SELECT doc, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 4), p AS (SELECT a.doc, b.doc AS other, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.doc <> b.doc GROUP BY 1, 2)
SELECT p.doc, other, round_even(shared / n, 4) AS share FROM p JOIN n ON p.doc = n.doc WHERE shared * 10 >= n * 8 QUALIFY row_number() OVER (PARTITION BY p.doc ORDER BY other) = 1"""
)
def dd13_first_match_by_keys(t: Tables) -> DataFrame:
    return reposts.first_matches(_lines(t))


@query(
    f"""WITH RECURSIVE k AS ({_KEYS}), n AS (SELECT doc, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 4), p AS (SELECT a.doc, b.doc AS other, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.doc <> b.doc GROUP BY 1, 2),
f AS (SELECT p.doc, other, round_even(shared / n.n, 4) AS share FROM p JOIN n ON p.doc = n.doc JOIN n m ON m.doc = p.other WHERE shared * 10 >= n.n * 8 QUALIFY row_number() OVER (PARTITION BY p.doc ORDER BY other) = 1),
s AS (SELECT doc, other, other < doc AND other IN (SELECT doc FROM f) AS leads FROM f), c AS (SELECT doc, other, leads FROM s UNION ALL SELECT c.doc, s.other, s.leads FROM c JOIN s ON s.doc = c.other WHERE c.leads),
g AS (SELECT doc, other AS group_id FROM c WHERE NOT leads)
SELECT g.doc, group_id, share FROM g JOIN f ON f.doc = g.doc UNION ALL SELECT DISTINCT group_id, group_id, NULL FROM g WHERE group_id NOT IN (SELECT doc FROM f)"""
)
def dd13_conclusion_groups(t: Tables) -> DataFrame:
    """Each document that matches another one, or is matched, with the group it comes to in the order of ids."""
    return reposts.conclusion_groups(reposts.first_matches(_lines(t))).withColumnRenamed("id", "doc")


def _items(t: Tables) -> DataFrame:
    """id and body, without white space, of the documents that aren't copies of earlier ones."""
    return saved(reposts.copies(t.documents).where("id = original").select("id", "body"))


def _pairs_sql(rest: str) -> str:
    """SQL over x (id, body, n), p (id, n, pos, g), k (id, other): documents that aren't copies, their grams, and pairs with a shared gram, of which id is the shorter or later."""
    return f"""WITH d AS (SELECT doc_id AS id, {_SQUASH.format("coalesce(text, '')")} AS body FROM documents), x AS (SELECT min(id) AS id, body, length(body) AS n FROM d GROUP BY body),
p AS (SELECT id, n, i - 1 AS pos, hash(substr(body, i, 12)) AS g FROM x, unnest(range(1, n - 10)) AS u(i)), s AS (SELECT * FROM p WHERE g IN (SELECT g FROM p GROUP BY g HAVING min(id) <> max(id))),
c AS (SELECT DISTINCT id, n, g FROM s), k AS (SELECT DISTINCT a.id, b.id AS other FROM c a JOIN c b ON a.g = b.g AND (a.n < b.n OR (a.n = b.n AND a.id > b.id))),
m AS (SELECT k.id, k.other, s.n, s.pos, s.pos - lag(s.pos) OVER (PARTITION BY k.id, k.other ORDER BY s.pos) AS step FROM k JOIN s ON s.id = k.id JOIN c ON c.id = k.other AND c.g = s.g),
b AS (SELECT id, other, sum(least(12, coalesce(step, 12))) / any_value(n) AS bound FROM m GROUP BY 1, 2) {rest}"""


@query(_pairs_sql("SELECT id, other, round(bound, 6) AS bound FROM b WHERE bound >= 0.60::DOUBLE"))
def dd16_cover_bound(t: Tables) -> DataFrame:
    """Pairs whose shared grams may cover enough for a repost."""
    return reposts.covered_pairs(_items(t), ()).select("id", "other", F.round("bound", 6).alias("bound"))


@query(_pairs_sql("SELECT b.id, b.other FROM b JOIN x ON x.id = b.id WHERE bound >= 0.60::DOUBLE"))
def dd15_run_candidates(t: Tables) -> DataFrame:
    """Candidate pairs: a run of MIN_RUN characters in common, and cover enough for a repost."""
    return reposts.covered_pairs(_items(t), ()).select("id", "other")


@query(
    _pairs_sql(
        """, q AS (SELECT id, other FROM b WHERE bound >= 0.60::DOUBLE), l AS (SELECT id, n, ch, count(*) AS k FROM (SELECT id, n, unnest(string_split(body, '')) AS ch FROM x WHERE id IN (SELECT id FROM q UNION SELECT other FROM q)) WHERE ch <> '' GROUP BY 1, 2, 3)
SELECT q.id, q.other, sum(least(a.k, o.k))::BIGINT AS letters, sum(least(a.k, o.k)) >= 0.6 * any_value(a.n) AS may_be_repost FROM q JOIN l a ON a.id = q.id JOIN l o ON o.id = q.other AND o.ch = a.ch GROUP BY 1, 2"""
    )
)
def dd07_letter_bag_bound(t: Tables) -> DataFrame:
    return reposts.covered_pairs(_items(t), ("letters",)).select("id", "other", "letters", (F.col("letters") >= 0.6 * F.col("n")).alias("may_be_repost"))


@query()
def dd05_overlap(t: Tables) -> DataFrame:
    """Coverage and longest run of pairs whose bound allows for a repost, and whether they are one."""
    found = reposts.covered_pairs(_items(t), ("runs",))
    return found.select("id", "other", F.bround("coverage", 4).alias("coverage"), "longest", (F.col("coverage") >= COPY_SHARE).alias("repost"))


@query(
    f"""WITH d AS (SELECT doc_id AS id, {_SQUASH.format("coalesce(text, '')")} AS body FROM documents), x AS (SELECT min(id) AS id, body, length(body) AS n FROM d GROUP BY body),
p AS (SELECT DISTINCT id, n, substr(body, i, 40) AS g FROM x, unnest(range(1, n - 38)) AS u(i)), s AS (SELECT * FROM p WHERE g IN (SELECT g FROM p GROUP BY g HAVING count(*) > 1))
SELECT DISTINCT a.id, b.id AS other FROM s a JOIN s b ON a.g = b.g AND (a.n < b.n OR (a.n = b.n AND a.id > b.id))"""
)
def dd06_decisive_runs(t: Tables) -> DataFrame:
    """Pairs with a run of DECISIVE_RUN characters in common."""
    return reposts.decisive_runs(_items(t))


@query()
def dd06_duplicates(t: Tables) -> DataFrame:
    """Pairs of one source, and by which of the two rules."""
    return reposts.duplicates(_items(t))


@query()
def dd08_best_originals(t: Tables) -> DataFrame:
    return reposts.best_originals(reposts.covered_pairs(_items(t), ("runs",))).select("id", "original", F.bround("coverage", 4).alias("coverage"))


@query()
def dd10_repost_groups(t: Tables) -> DataFrame:
    """The state in which each document is imported, its original, and its group."""
    return reposts.repost_groups(t.documents)


@query(
    _pairs_sql(
        """, q AS (SELECT id, other FROM b WHERE bound >= 0.60::DOUBLE), g AS (SELECT DISTINCT id, substr(body, i, 4) AS g FROM x, unnest(range(1, n - 2)) AS u(i) WHERE id IN (SELECT id FROM q UNION SELECT other FROM q)),
z AS (SELECT id, count(*) AS n FROM g GROUP BY 1), y AS (SELECT q.id, q.other, count(*) AS shared FROM q JOIN g a ON a.id = q.id JOIN g o ON o.id = q.other AND o.g = a.g GROUP BY 1, 2)
SELECT y.id, other, round(shared / (a.n + o.n - shared), 6) AS jaccard, round(shared / least(a.n, o.n), 6) AS containment FROM y JOIN z a ON a.id = y.id JOIN z o ON o.id = y.other"""
    )
)
def dd14_gram_jaccard(t: Tables) -> DataFrame:
    """Likeness by grams of four characters of the candidate pairs."""
    return reposts.covered_pairs(_items(t), ("grams",)).select("id", "other", F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"))


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""WITH f AS (SELECT doc_id, text, greatest(strpos(text, 'Idiot') - 1, 0) AS "at" FROM documents WHERE contains({_FOLD.format("text")}, 'idiot') OR contains({_FOLD.format("source")}, 'idiot') ORDER BY doc_id DESC LIMIT 50)
SELECT doc_id, "at", CASE WHEN "at" > 40 THEN '…' ELSE '' END || substr(text, greatest(0, "at" - 40) + 1, least(length(text), "at" + 40) - greatest(0, "at" - 40)) || CASE WHEN "at" + 40 < length(text) THEN '…' ELSE '' END AS snippet FROM f"""
)
def fl03_documents_containing(t: Tables, phrase: str = " Idiot ", limit: int = 50) -> DataFrame:
    """The newest documents with the phrase in their text or source, whatever the case of its ASCII letters, with its place and the text around it."""
    index = phrases.build_index(t.documents, "doc_id", ["text", "source"])
    found = phrases.containing(index, t.documents, phrase, limit)
    return found.select("doc_id", F.col("at").cast("long").alias("at"), T.snippet(F.col("text"), F.col("at")).alias("snippet"))


@query("SELECT item_id, min(doc_id) AS doc_id, count(*) AS documents FROM benchmark b JOIN documents d ON contains(d.text, trim(b.text)) GROUP BY 1")
def fl04_benchmark_in_documents(t: Tables) -> DataFrame:
    items = t.benchmark.select(F.col("item_id").alias("quote_id"), F.trim("text").alias("form"))
    found = quotes.holders(items, t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("body")))
    return found.groupBy(F.col("quote_id").alias("item_id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("documents"))


_LOOSE_OF = f"translate({{}}, {_MARKS}, '')"


@query(
    f"""WITH q AS (SELECT item_id, trim(text) AS q, {_LOOSE_OF.format("trim(text)")} AS lq FROM benchmark), d AS (SELECT doc_id, text AS body, {_LOOSE_OF.format("text")} AS lb FROM documents),
f AS (SELECT item_id, doc_id, q, lq, body, lb, CASE WHEN contains(body, q) THEN 'exact' ELSE 'loose' END AS verdict FROM q JOIN d ON length(q) >= 6 AND (contains(body, q) OR (lq <> '' AND contains(lb, lq)))),
p AS (SELECT *, CASE WHEN verdict = 'loose' THEN list_filter(range(1, length(body) + 1), lambda i: NOT contains({_MARKS}, substr(body, i, 1))) END AS kept FROM f)
SELECT item_id, doc_id, verdict, CASE WHEN verdict = 'exact' THEN strpos(body, q) - 1 ELSE kept[strpos(lb, lq)] - 1 END AS char_start, CASE WHEN verdict = 'exact' THEN strpos(body, q) - 1 + length(q) ELSE kept[strpos(lb, lq) + length(lq) - 1] END AS char_end FROM p
UNION ALL SELECT item_id, NULL, CASE WHEN length(q) < 6 THEN 'too_short' ELSE 'missing' END, -1, -1 FROM q WHERE item_id NOT IN (SELECT item_id FROM f)"""
)
def ql01_quote_places(t: Tables) -> DataFrame:
    """Where each passage stands in the documents, exactly or but for marks; passages that none holds have one row."""
    found = quotes.quote_places(t.benchmark.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("body")))
    return found.select(F.col("quote_id").alias("item_id"), "doc_id", "verdict", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


_CLAIMS = """SELECT doc_id, i, quote, body FROM (SELECT doc_id, body, i, CASE i WHEN 0 THEN substr(body, 4, 40) WHEN 1 THEN translate(substr(body, 10, 30), ' ', '') WHEN 2 THEN substr(body, 1, 5) WHEN 3 THEN 'not in ' || doc_id ELSE chr(9) || substr(body, 2, 20) || chr(10) END AS quote FROM b, range(5) AS u(i))"""


def _claims(t: Tables) -> DataFrame:
    """Five claims on each document, whose quotes are of it, of it without blanks, too short, of nowhere, and of it between a tab and a line end."""
    heads = t.documents.select("doc_id", F.left(T.normal_body(F.col("text")), F.lit(43)).alias("body"))  # all that a quote is made of, once a document
    rows = heads.select("doc_id", "body", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    quote = (
        F.when(F.col("i") == 0, F.substring("body", 4, 40)).when(F.col("i") == 1, F.translate(F.substring("body", 10, 30), " ", "")).when(F.col("i") == 2, F.substring("body", 1, 5))
        .when(F.col("i") == 3, F.concat(F.lit("not in "), F.col("doc_id"))).otherwise(F.concat(F.lit("\t"), F.substring("body", 2, 20), F.lit("\n")))
    )
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), quote.alias("quote"))


_BODIES = f"b AS (SELECT doc_id, {_BODY.format('text')} AS body FROM documents)".replace("'\\n'", "chr(10)").replace("E'\\n\\n'", "chr(10) || chr(10)")
_STRIP = "regexp_replace(quote, '^[\\s\\p{Z}\\x1c-\\x1f\\x85]+|[\\s\\p{Z}\\x1c-\\x1f\\x85]+$', '', 'g')"
_CHECKED = f"""WITH {_BODIES}, c AS (SELECT *, {_STRIP} AS q FROM ({_CLAIMS})), l AS (SELECT *, {_LOOSE_OF.format('q')} AS lq, {_LOOSE_OF.format('body')} AS lb FROM c),
v AS (SELECT doc_id, i, quote, q, lq, lb, body, CASE WHEN length(q) < 6 THEN 'too_short' WHEN contains(body, q) THEN 'exact' WHEN lq <> '' AND contains(lb, lq) THEN 'loose' ELSE 'missing' END AS verdict FROM l)"""


@query(_CHECKED + " SELECT doc_id, count(*) AS candidates, count_if(verdict IN ('exact', 'loose'))::BIGINT AS accepted, count_if(verdict = 'loose')::BIGINT AS loose, count_if(verdict NOT IN ('exact', 'loose'))::BIGINT AS dropped, round(count_if(verdict NOT IN ('exact', 'loose')) / count(*), 6) AS drop_ratio FROM v GROUP BY 1")
def ql02_verified_claims(t: Tables) -> DataFrame:
    return quotes.verification_counts(quotes.verified(_claims(t), t.documents))


@query(
    _CHECKED
    + f""", k AS (SELECT *, CASE WHEN verdict = 'loose' THEN list_filter(range(1, length(body) + 1), lambda i: NOT contains({_MARKS}, substr(body, i, 1))) END AS kept FROM v WHERE verdict IN ('exact', 'loose'))
SELECT doc_id, i, quote, verdict, (CASE WHEN verdict = 'exact' THEN strpos(body, q) - 1 ELSE kept[strpos(lb, lq)] - 1 END)::INT AS char_start, (CASE WHEN verdict = 'exact' THEN strpos(body, q) - 1 + length(q) ELSE kept[strpos(lb, lq) + length(lq) - 1] END)::INT AS char_end FROM k"""
)
def ql04_gold_quotes(t: Tables) -> DataFrame:
    """Labels whose quote stands in their document, exactly or loosely, with its place; others are turned away."""
    return quotes.verified(_claims(t), t.documents).where("accepted").select("doc_id", "i", "quote", "verdict", "char_start", "char_end")


@query(
    """WITH n AS (SELECT DISTINCT w AS name FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM conversations) WHERE length(w) >= 5), d AS (SELECT doc_id, concat_ws(' ', source, text, lang) AS x FROM documents),
c AS (SELECT doc_id, name, ((length(x) - length(replace(x, name, ''))) // length(name))::BIGINT AS n FROM d JOIN n ON contains(x, name))
SELECT doc_id, name, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name) = 1"""
)
def ql05_most_named(t: Tables) -> DataFrame:
    """The name that occurs most often in the title, text and context of each document; names are all words of five letters or more of the conversations."""
    names = t.conversations.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("name")).where("length(name) >= 5").distinct()
    texts = t.documents.select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "text", "lang").alias("text"))
    return naming.most_named(texts, names).select(F.col("id").alias("doc_id"), "name", "n")


@query("SELECT doc_id, n_name, (length(u) - length(replace(u, w, ''))) // length(w) AS n FROM (SELECT doc_id, upper(text) AS u, n_name, left(n_name, 3) AS w FROM documents, nation) WHERE contains(u, w) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (length(u) - length(replace(u, w, ''))) // length(w) DESC, n_name) = 1")
def ql05_most_named_place(t: Tables) -> DataFrame:
    names = F.broadcast(t.nation.select("n_name", F.left("n_name", F.lit(3)).alias("w")))  # a fixed list of places
    rows = t.documents.select("doc_id", F.upper("text").alias("u")).join(names, F.col("u").contains(F.col("w")))
    rows = rows.select("doc_id", "n_name", T.occurrences(F.col("u"), F.col("w")).cast("long").alias("n"))
    return rows.groupBy("doc_id").agg(F.max_by("n_name", F.struct("n", F.transform(F.split("n_name", ""), lambda c: -F.ascii(c)))).alias("n_name"), F.max("n").alias("n"))


_VISIBLE = "html"
for _name in T.HIDDEN_BLOCKS.split("|"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_name}\\b.*?</{_name}>', '', 'g')"
_VISIBLE = f"regexp_replace(regexp_replace(regexp_replace({_VISIBLE}, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(p|div|li|tr|h[1-6]|section|article|blockquote|br)\\s*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _name, _char in T.ENTITIES:
    _VISIBLE = f"replace({_VISIBLE}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"
_VISIBLE = _BODY.format(_VISIBLE).replace("'\\n'", "chr(10)").replace("E'\\n\\n'", "chr(10) || chr(10)")


@query(f"SELECT page_id, length(x) AS n_chars, sha256(x) AS text_sha256 FROM (SELECT page_id, {_VISIBLE} AS x FROM pages)")
def ql06_visible_text(t: Tables) -> DataFrame:
    body = T.html_to_text(F.col("html"))
    return t.pages.select("page_id", F.length(body).cast("long").alias("n_chars"), F.sha2(body, 256).alias("text_sha256"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1))"
_SITE = " ".join(f"WHEN host = '{domain}' OR ends_with(host, '.{domain}') THEN '{site}'" for domain, site in T.SITES)


@query(f"SELECT page_id, CASE {_SITE} ELSE 'manual' END AS site FROM (SELECT page_id, {_HOST} AS host FROM (SELECT page_id, replace(url, '.example.com', CASE page_id % 4 WHEN 0 THEN '.zhihu.com' WHEN 1 THEN '.qyer.com' ELSE '.example.com' END) AS url FROM pages))")
def fl11_site_of_page(t: Tables) -> DataFrame:
    """The site of each page; half of the example hosts stand for known ones."""
    host = F.when(F.col("page_id") % 4 == 0, ".zhihu.com").when(F.col("page_id") % 4 == 1, ".qyer.com").otherwise(".example.com")
    return t.pages.select("page_id", T.site_of(F.replace("url", F.lit(".example.com"), host)).alias("site"))


_EXTERNAL = " || ".join("regexp_extract_all(html, '(?i)" + x.replace("'", "''") + "', 1)" for x in T.LOADED)


@query(f"SELECT page_id, len(list_filter({_EXTERNAL}, lambda x: starts_with(x, 'http://') OR starts_with(x, 'https://') OR starts_with(x, '//'))) AS n_external FROM pages")
def snk06_external_resources(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(T.external_resources(F.col("html"))).cast("long").alias("n_external"))


_CACHE_KEY = "sha256('v1' || chr(0) || coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, ''))"


def _cache_key() -> F.Column:
    """Version, model, title and body, parted by zero bytes."""
    return F.sha2(F.concat_ws("\0", F.lit("v1"), *[F.coalesce(x, F.lit("")) for x in ("lang", "source", "text")]), 256)


@query(
    f"""WITH c AS (SELECT {_CACHE_KEY} AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1), h AS (SELECT {_CACHE_KEY} AS key, max(doc_id) AS doc_id FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT c.key, coalesce(h.doc_id, c.doc_id) AS doc_id, h.key IS NOT NULL AS hit FROM c LEFT JOIN h USING (key)"""
)
def src20_result_cache(t: Tables) -> DataFrame:
    """Results by key after a run: those in the cache, where of rows with one key the last stands, and the misses that were added."""
    asked = t.documents.groupBy(_cache_key().alias("key")).agg(F.min("doc_id").alias("own"))
    cache = t.documents.join(t.labels, "doc_id").groupBy(_cache_key().alias("key")).agg(F.max("doc_id").alias("held"))
    return asked.join(cache, "key", "left").select("key", F.coalesce("held", "own").alias("doc_id"), F.col("held").isNotNull().alias("hit"))


_SPANS = """SELECT conv_id, turn, span_id, CASE span_id WHEN 0 THEN -3 WHEN 1 THEN n // 3 WHEN 2 THEN n // 2 ELSE n - 2 END AS a, CASE span_id WHEN 0 THEN n // 2 WHEN 1 THEN 2 * n // 3 WHEN 2 THEN n // 2 ELSE n + 9 END AS b FROM (SELECT conv_id, turn, length(text) AS n FROM conversations), range(4) AS u(span_id)"""


@query(
    f"""WITH s AS ({_SPANS}), t AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations), i AS (SELECT s.conv_id, s.turn, span_id, least(greatest(a, 0), n) AS a, least(greatest(b, 0), n) AS b FROM s JOIN t ON s.conv_id = t.conv_id AND s.turn = t.turn),
o AS (SELECT * FROM i WHERE a < b), c AS (SELECT conv_id, turn, list_sort(list_distinct(list(p))) AS c FROM (SELECT conv_id, turn, a AS p FROM o UNION ALL SELECT conv_id, turn, b FROM o UNION ALL SELECT conv_id, turn, 0 FROM t UNION ALL SELECT conv_id, turn, n FROM t) GROUP BY 1, 2),
p AS (SELECT conv_id, turn, k - 1 AS part, c[k] AS x, c[k + 1] AS y FROM c, unnest(range(1, len(c))) AS u(k))
SELECT p.conv_id, p.turn, part, substr(text, x::BIGINT + 1, (y - x)::BIGINT) AS piece, coalesce((SELECT list_sort(list(span_id)) FROM o WHERE o.conv_id = p.conv_id AND o.turn = p.turn AND o.a <= x AND o.b >= y), []) AS covering FROM p JOIN t ON t.conv_id = p.conv_id AND t.turn = p.turn"""
)
def ql07_cut_at_spans(t: Tables) -> DataFrame:
    n, k = F.col("n"), F.col("span_id")
    spans = t.conversations.select("conv_id", "turn", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("span_id"))
    half = F.floor(n / 2)
    a = F.when(k == 0, -3).when(k == 1, F.floor(n / 3)).when(k == 2, half).otherwise(n - 2)
    b = F.when(k == 0, half).when(k == 1, F.floor(2 * n / 3)).when(k == 2, half).otherwise(n + 9)
    spans = spans.select("conv_id", "turn", k.cast("long").alias("span_id"), a.cast("int").alias("char_start"), b.cast("int").alias("char_end"))
    return quotes.segments(t.conversations, spans, ["conv_id", "turn"], "text").withColumn("part", F.col("part").cast("long"))


@query("SELECT conv_id, turn, lead(role) OVER w AS next_role, length(text) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def jn14_next_turn(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_role"), F.length("text").cast("long").alias("n"))
