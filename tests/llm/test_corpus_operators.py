"""Each corpus operator on a small table with nulls, empty and long texts, ties, repeated texts and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import bpe, exact_dedup, imatch, langid, line_dedup, mixing, simhash, suffix_dedup, token_files, toxicity

WORDS = "the river old mill stone grinds corn until evening light falls over quiet fields where cattle rest".split()
SCHEMA = "doc_id long, text string, lang string, source string, sha string, h1 long, guest string, key string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n))


def build():
    rng = random.Random(3)
    base = [sentence(rng, rng.randint(5, 60)) for _ in range(30)]
    long_line = sentence(rng, 40)
    texts = [None, "", " \t\n", "...", "a", *base]
    texts += [base[0], base[1] + " ", base[2].replace("river", "rivet"), base[3].upper()]
    texts += [long_line + "\n" + base[4], base[5] + "\n" + long_line, base[6] + "\n" + long_line[:20] + "x" + long_line[21:]]
    texts += [base[7] + " " + base[8], "x" * 300, "naïve café ①½ \x1c été İstanbul 北京   <|endoftext|> don't we'll", sentence(rng, 3000)]
    texts += [base[9][:-1] + "!", "short line\nshort line\nother", "\n\n"]
    ids = list(range(100, 100 + 3 * len(texts), 3))
    rng.shuffle(ids)
    return [(i, t, "en", f"s{i % 4}" if i % 7 else None, "x", 1, "g", "k") for i, t in zip(ids, texts)]


ROWS = sorted(build())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {row["doc_id"]: row for row in df.collect()}


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    found = by_id(exact_dedup.exact_duplicates(docs))
    assert len(found) == len(ROWS)
    for text, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            row = found[i]
            assert (row["keep_id"], row["group_size"], row["kept"]) == (keep, len(members), i == keep)
            assert row["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert by_id(exact_dedup.exact_duplicates(docs, max_bits=1024)) == found  # a filter that is far too small
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == len(groups)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for letters in (1, 2, 3, 256):
        for n in (1, 2, 9, 200):
            text = rng.integers(0, letters, n).astype(np.uint8)
            data = text.tobytes()
            assert suffix_dedup.suffix_array(text, n).tolist() == sorted(range(n), key=lambda i: data[i:])


def test_suffix_dedup(docs, empty, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)  # the longest text is cut into pieces
    first = {}
    for i, t, *_ in ROWS:
        data = (t or "").encode()
        for p in range(len(data) - 49):
            first.setdefault(data[p : p + 50], i)
    found = by_id(suffix_dedup.repeat_report(docs))
    assert len(found) == len(ROWS)
    for i, t, *_ in ROWS:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, int)
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < i:
                gone[p : p + 50] = 1
        kept = bytes(c for c, g in zip(data, gone) if not g)
        row = found[i]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(data), gone.sum(), (np.diff(np.append(0, gone)) == 1).sum())
        assert row["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert sum(r["n_removed"] for r in found.values()) > 0
    assert suffix_dedup.repeat_report(empty).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_simhash(docs, empty, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    prints = {i: slow_fingerprint(t) for i, t, *_ in ROWS}
    label = {i: i for i in prints}
    for _ in range(len(label)):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    found = by_id(simhash.near_duplicates(docs))
    assert {i: (f"{p:016x}", label[i]) for i, p in prints.items()} == {i: (r["fingerprint"], r["component_id"]) for i, r in found.items()}
    assert simhash.near_duplicates(empty).count() == 0


def test_near_tiles():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    prints[150:] = prints[:150] ^ (np.uint64(1) << rng.integers(0, 60, 150).astype(np.uint64))
    label = simhash.linked_classes(prints, 4, tile=16)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    for a, b in zip(*np.nonzero(near)):
        assert label[a] == label[b]
    assert len(set(label)) == 150


def test_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    found = by_id(bpe.round_trip(docs, path))
    ids = by_id(bpe.encode(docs, path))
    back = by_id(bpe.decode(bpe.encode(docs, path), path))
    for i, t, *_ in ROWS:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert ids[i]["ids"] == want
        assert back[i]["text"] == (t or "")
        assert found[i]["n_tokens"] == len(want)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty, path).count() == 0


def test_bpe_words_at_random():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, coder, rng = Tokenizer.from_file(path), bpe.BpeEncoder(bpe.compile_vocabulary(path)), random.Random(5)
    letters = "aaabcdeeeilmnorsttu éß0 .-_\n"
    coder.transitions.most = 300  # the table is begun anew, again and again
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        assert coder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_fingerprints_of_edits(docs, empty):
    found = by_id(imatch.fingerprints_of_edits(docs, band=(0.03, 0.9)))
    assert len(found) == len(ROWS)
    texts = [t or "" for _, t, *_ in ROWS]
    same = defaultdict(set)
    for n, (i, *_) in enumerate(ROWS):
        own, after = texts[n], texts[n - 1]
        third = len(own) // 3
        row = found[i]
        assert (row["n_chars"], row["edited_sha256"]) == (len(own), hashlib.sha256((own[: len(own) - third] + after[:third]).encode()).hexdigest())
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        same[own].add(row["fingerprint"])
        if own[: len(own) - third] + after[:third] == own:
            assert row["near_edited"] == 1 and row["fingerprint"] == row["edited_fingerprint"]
    assert all(len(x) == 1 for x in same.values())
    assert imatch.fingerprints_of_edits(empty).count() == 0


def test_fingerprints_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_DOCS", 2)
    rows = [(i, f"text number {i} of this table") for i in (3, 4, 5, 40, 41, 99)]
    found = by_id(imatch.fingerprints_of_edits(spark.createDataFrame(rows, "doc_id long, text string"), band=(0, 1)))
    for n, (i, own) in enumerate(rows):
        third = len(own) // 3
        assert found[i]["edited_sha256"] == hashlib.sha256((own[: len(own) - third] + rows[n - 1][1][:third]).encode()).hexdigest()


def test_fingerprints_of_crowded_ids_and_strings(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_DOCS", 2)
    names = [*range(-40, 40), 1 << 62, -(1 << 63), (1 << 63) - 1]
    for kind, ids in (("long", sorted(names)), ("string", sorted(map(str, names)))):
        rows = [(i, f"text number {n} of this table") for n, i in enumerate(ids)]
        found = imatch.fingerprints_of_edits(spark.createDataFrame([*rows, (None, "last"), (None, "last")], f"doc_id {kind}, text string"), band=(0, 1)).collect()
        assert len(found) == len(rows) + 2
        edited = {r["doc_id"]: r["edited_sha256"] for r in found}
        for n, (i, own) in enumerate(rows):
            third, after = len(own) // 3, rows[n - 1][1] if n else "last"
            assert edited[i] == hashlib.sha256((own[: len(own) - third] + after[:third]).encode()).hexdigest()


def test_token_files(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, start = Tokenizer.from_file(path), 0
    found = by_id(token_files.token_file_rows(docs, path))
    for i, t, *_ in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        row = found[i]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_file_rows(empty, path).count() == 0


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for x, p in enumerate(a, 1):
        row = [x]
        for y, q in enumerate(b, 1):
            row.append(min(last[y] + 1, row[-1] + 1, last[y - 1] + (p != q)))
        last = row
    return last[-1]


def test_edit_distance():
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        pairs.append((a, "".join(b) or "a"))
    for edits in (1, 2, 3):
        found = line_dedup.edit_distances([a for a, _ in pairs], [b for _, b in pairs], edits)
        assert [min(edit_distance(a, b), edits + 1) for a, b in pairs] == np.minimum(found, edits + 1).tolist()


@pytest.mark.parametrize("hot", [False, True])
def test_line_dedup(docs, empty, hot, monkeypatch):
    if hot:  # every key goes by cells, of few lines
        for name, value in (("HOT_LINES", 2), ("HOT_HERE", 2), ("MOST_HOT", 1 << 30), ("CELL_LINES", 2), ("HOT_SHARE", 1)):
            monkeypatch.setattr(line_dedup, name, value)
        links = line_dedup._hot_links
        monkeypatch.setattr(line_dedup, "_hot_links", lambda *x: used.append(1) or links(*x))
    used = []
    first = {}
    for i, t, *_ in ROWS:
        for p, line in enumerate((t or "").split("\n")):
            first.setdefault(line, (i, p))
    long = [x for x in first if len(x) >= line_dedup.MIN_EDIT_CHARS]
    near = {x for x in long for y in long if first[y] < first[x] and abs(len(x) - len(y)) <= 2 and edit_distance(x, y) <= 2}
    assert near
    found = by_id(line_dedup.line_report(docs))
    assert len(found) == len(ROWS)
    for i, t, *_ in ROWS:
        lines = (t or "").split("\n")
        kept = [x for p, x in enumerate(lines) if len(x) < line_dedup.MIN_CHARS or first[x] == (i, p) and x not in near]
        row = found[i]
        assert (row["n_lines"], row["n_removed"]) == (len(lines) if t else 0, len(lines) - len(kept))
        assert row["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert bool(used) == hot
    assert line_dedup.line_report(empty).count() == 0


def test_lines_of_repeated_ids(spark):
    twice, own = "a line that comes twice in here", "something nobody else ever said at all"
    rows = [(1, twice), (2, twice), (2, own), (3, f"{own}\nlast"), (4, "x\nx"), (4, "x\nx"), (4, "y"), (None, twice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.drop_repeated_lines(docs).collect()), key=str) == sorted([(1, twice), (2, own), (3, "last"), (4, "x"), (4, "x"), (4, "y"), (None, twice)], key=str)
    assert sorted(r["n_removed"] for r in line_dedup.line_report(docs).collect()) == [0, 0, 0, 0, 1, 1, 1, 1]


def test_mixing(docs, empty):
    found = mixing.mix(docs)
    rows = by_id(found)
    assert rows == by_id(mixing.mix(docs.repartition(3)))
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in ROWS}
    source = {r[0]: r[3] for r in ROWS}
    total = defaultdict(int)
    for i, n in sizes.items():
        total[source[i]] += n
    order = sorted(total, key=lambda x: (x is None, x or ""))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(total.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 2 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        free -= full
    taken = defaultdict(int)
    for i, row in rows.items():
        assert (row["size"], row["source_size"]) == (sizes[i], total[source[i]])
        assert row["target"] == pytest.approx(target[source[i]])
        assert 0 <= row["taken"] <= 2 * row["size"]
        taken[source[i]] += row["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixing.mixed_documents(empty).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(160):
        text = sentence(rng, rng.randint(20, 200))
        if i % 4 == 0:
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(["zorgwretch", "zorgfiend,"])
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "123")]
    docs, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    network = toxicity.learn(docs, labelled.where("doc_id < 120"))
    found = by_id(toxicity.score(docs, network))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    assert sum(found[i]["predicted"] == y for i, y in labels if i >= 120) >= 36
    assert [found[i]["score"] for i in (900, 901, 902)] == [0, 0, 0]
    assert toxicity.score(empty, network).count() == 0
    twice = docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat("text", F.lit(" again"))))  # of repeated ids one text is learned
    again = by_id(toxicity.score(docs, toxicity.learn(twice, labelled.where("doc_id < 120"))))
    assert sum(again[i]["predicted"] == y for i, y in labels if i >= 120) >= 36
    assert toxicity.words_of("Id1ot, 123 z0rg-wretch é4") == [b"id1ot", b"z0rg", b"wretch", "é4".encode()]
    assert toxicity.learn(docs, labelled.where("toxic = 0")) == 0.0 and toxicity.learn(docs, labelled.where("false")) == 0.0


def test_gradients():
    rng = np.random.default_rng(0)
    words = [b"ab", b"abc", b"x", b"hello"]
    network = toxicity.Network({b"abc": 1}, np.arange(toxicity.CHAR_BUCKETS))
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    ids, mask = rng.integers(0, 4, (3, 5)), np.ones((3, 5))
    mask[1, 3:] = 0
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        logits, _ = network.forward(network.inputs(words)[ids.T].astype(np.float64), mask)
        p = 1 / (1 + np.exp(-logits))
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * w).mean())

    found = network.gradients(*network.looked_up(words), ids, mask, y, w)
    for name in ("Uf", "Ub", "Wf", "A", "v", "o", "k", "word"):
        at = np.unravel_index(np.argmax(np.abs(found[name])), found[name].shape)
        old = network.p[name][at]
        network.p[name][at] = old + 1e-2
        up = loss()
        network.p[name][at] = old - 1e-2
        down = loss()
        network.p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(found[name][at], rel=0.05, abs=1e-4), name


def test_language_id(spark, empty):
    rng = random.Random(4)
    other = "der alte mühle stein mahlt korn bis abend licht fällt über stille felder wo vieh ruht".split()
    rows = [(i, sentence(rng, 30), "en") if i % 2 else (i, " ".join(rng.choice(other) for _ in range(30)), "de") for i in range(100)]
    rows += [(200, None, "en"), (201, "", None), (202, "12 34 ...", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn_dictionaries(docs.where("doc_id < 60"))
    assert sorted(learned) == ["de", "en"]
    found = by_id(langid.predict_languages(docs, learned))
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows[60:100])
    assert all((found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True) for i in (200, 201, 202))
    assert sorted(r["doc_id"] for r in langid.drop_unidentified(docs, learned).collect()) == list(range(100))
    assert {r["lang_pred"] for r in langid.predict_languages(docs, {}).collect()} == {"und"}
    assert langid.predict_languages(empty, learned).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    out, kept = None, spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = kept.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            out.write.parquet(f"{tmp_path}/{n}.parquet")
            kept = spark.read.parquet(f"{tmp_path}/{n}.parquet")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == kept.count() > 0


@pytest.mark.parametrize("parts", [None, 3])
def test_near_copies(spark, tmp_path, parts, monkeypatch):
    import corpus_pipeline

    if parts:
        monkeypatch.setattr(simhash, "SMALL_PART", parts)
        monkeypatch.setattr(simhash, "BUCKET", 5)
        monkeypatch.setattr(simhash, "FEW", 2)
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 300]))]
        for edits in (0, 0.01, 0.02, 0.025, 0.03, 0.04, 0.06, 0.1):
            texts.append(" ".join("new" + w if rng.random() < edits else w for w in words))
    texts += ["", " ", "one two", "One  two", "one three", texts[0].upper()]

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(x) for x in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    docs = spark.createDataFrame([(None, texts[0]), *enumerate(texts)], "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert kept.count(None) == 1 and sorted(x for x in kept if x is not None) == sorted(set(root))
    assert len(set(root)) > 20


def test_language_id_rejects_gibberish(spark):
    rng = random.Random(8)
    other = "der alte mühle stein mahlt korn bis abend licht fällt über stille felder wo vieh ruht".split()
    clean = [(i, sentence(rng, 30), "en") if i % 2 else (i, " ".join(rng.choice(other) for _ in range(30)), "de") for i in range(60)]

    def junk(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))

    gibberish = [(100 + i, junk("abcdefghijklmnopqrstuvwxyz" if i % 2 else "0123456789abcdef", 400), "en") for i in range(40)]
    short = [(200, "Die.", "de"), (201, "A.", "en")]
    docs = spark.createDataFrame(clean + gibberish + short + [(202, "北京", "zh")], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.drop_unidentified(docs, langid.learn_dictionaries(docs.where("doc_id < 60"))).collect()}
    assert kept >= {*range(60), 200, 201} and 202 not in kept
    assert sum(100 <= x < 200 for x in kept) <= 2


def test_short_lines(spark):
    line = "a line of some thirty letters."
    texts = ["Les.\n" + line + "\n \n", "Les.\n" + line.replace("some", "same") + "\n \n", "Le.\n" + line.replace("some", "sane") + "\nfew letters here\n", "few letters hers\nLe."]
    # either side of the length from which two edits are allowed
    long = "a line that is of just forty characters."
    texts += [long, long[:-2], long[:-1] + "!x", long[1:]]
    assert len(line) == 30 and len(long) == 40
    found = by_id(line_dedup.line_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    lines, first, gone = [(i, p, x) for i, t in enumerate(texts) for p, x in enumerate(t.split("\n"))], [], [0] * len(texts)
    for i, _, x in lines:
        fits = lambda y: 2 if min(len(x), len(y)) >= 40 else 1 if min(len(x), len(y)) >= 20 else 0  # noqa: B023, E731
        gone[i] += bool(x.strip()) and any(edit_distance(x, y) <= fits(y) for y in first)
        first.append(x)
    assert [found[i]["n_removed"] for i in range(len(texts))] == gone
    assert gone[:4] == [0, 2, 1, 1] and gone[7] == 1
