"""Language id, token counts, URL filter, chat, decontamination and segmentations."""

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchframe.llm import chat, decontamination, language_id, sentencepiece_sampling, token_counts, url_filter
from matchframe.llm.words import mix, split_words, text_bytes, word_blocks

from .common import awkward, awkward_rows, empty, prose, words

SF = "/root/testdata/sf0.01"


# --- words ---


def test_words_and_grams():
    texts = ["a  bb\tccc\n", "", " x ", None, "a bb ccc", "é\u00a0é"]
    for _, _, got in word_blocks(pa.array(texts)):
        spelled = [bytes(got.data[s:e]).decode() for s, e in zip(got.start, got.end, strict=True)]
        assert spelled == [w for t in texts for w in words(t)]
        assert got.counts.tolist() == [len(words(t)) for t in texts]
        same = collections.defaultdict(set)
        for w, h in zip(spelled, got.hash.tolist(), strict=True):
            same[w].add(h)
        assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)
        grams = got.grams(3)
        assert grams[0] == grams[4] and len(set(grams.tolist())) == 5
        assert got.gram_starts(3).tolist() == [0, 4]


def test_sliced_arrow_columns():
    data, offsets = text_bytes(pa.array(["ab", "c", None, "de"]).slice(1, 3))
    assert data.tobytes() == b"cde" and offsets.tolist() == [0, 1, 1, 3]
    assert len(split_words(np.zeros(0, np.uint8), np.zeros(1, np.int64)).hash) == 0


# --- language id ---


def test_automaton_knows_exactly_the_substrings():
    rng = random.Random(1)
    text = [rng.randrange(3) for _ in range(60)]
    table = language_id.build_automaton(text, 3)
    inside = {tuple(text[i:j]) for i in range(60) for j in range(i, 61)}
    for n in range(1, 7):
        for probe in itertools.product(range(3), repeat=n):
            state = 0
            for c in probe:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == (probe in inside)


def test_phrases_are_greedy_longest_matches():
    sample = "the cat sat on the mat and the dog ran"
    known = language_id.fit({"en": [sample], "xx": ["zq qz zzq"]}, 1000)
    for probe in ("the dog sat", "cat and mat", "zzz qq", "a"):
        table = known.symbol_tables()[0]
        symbols = table[np.array([ord(c) for c in probe])]
        got = language_id.phrases(symbols, np.array([0, len(symbols)]), known)[0]
        for name, text, n in (("en", sample, got[0]), ("xx", "zq qz zzq", got[1])):
            i = count = 0
            while i < len(probe):
                j = i + 1
                while j < len(probe) and probe[i : j + 1] in text:
                    j += 1
                count, i = count + 1, j
            assert n == count, (name, probe)


def test_language_id_cases(spark):
    docs = awkward(spark)
    out = language_id.identify(docs, F.lit(True))
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()
    for i, t, *_ in awkward_rows():
        letters = any(c.isalpha() for c in t or "")
        assert (got[i, t]["lang_pred"] == "und") == (not letters)
        assert 0 <= got[i, t]["score"] <= 1
    assert language_id.identify(empty(spark), F.lit(True)).count() == 0
    unlabelled = language_id.identify(docs, F.lit(False))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    out = language_id.identify(docs.select("doc_id", "text", "lang"), fold != 2).where(fold == 2)
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_prediction_ignores_labels_of_held_out_rows(spark):
    rows = [(i, ("der und die ist " if i % 2 else "the and of is ") * 9 + str(i), "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = F.col("doc_id") < 20
    a = language_id.identify(docs, seen)
    b = language_id.identify(docs.withColumn("lang", F.when(seen, F.col("lang")).otherwise("xx")), seen)
    pick = lambda d: sorted(tuple(r) for r in d.select("doc_id", "lang_pred", "score").collect())
    assert pick(a) == pick(b)


def test_scripts_of_thousands_of_letters(spark):
    rng = random.Random(5)
    words = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2)) for _ in range(900)]
    han = lambda: "".join(rng.choice(words) for _ in range(300))
    noise = lambda: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(600))
    latin = ["river", "stone", "green", "light", "walk", "over", "under", "house", "and", "the"]
    english = lambda: " ".join(rng.choice(latin) for _ in range(150))
    rows = [(i, han() if i % 2 else english(), "zh" if i % 2 else "en") for i in range(160)]
    rows += [(1000, noise(), None), (1001, words[0][0], None), (1002, "".join(rng.choice("qxzjkvw") for _ in range(400)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs, F.col("doc_id") < 100).collect()}
    assert all(got[i]["lang_pred"] == lang and not got[i]["strange"] for i, _, lang in rows[100:160])
    assert got[1000]["strange"] and got[1002]["strange"]
    assert not got[1001]["strange"] and got[1001]["lang_pred"] == "zh"


def test_letters_have_codes_of_their_own_and_symbols_are_shared_evenly():
    for n in (0, 1, language_id.LETTERS, language_id.LETTERS + 1, 3000):
        codes = set(zip(*(c.tolist() for c in language_id._codes(n)), strict=True))
        assert len(codes) == n and all(a > 1 for a, _ in codes)
    assert language_id._even([5, 100, 100], 105) == 50
    assert language_id._even([5, 6], 100) == 6 and language_id._even([], 9) == 0
    long, short = "abc " * 5000, "xyz"
    known = language_id.fit({"en": [long, long.upper(), short]}, 1000)
    assert set(map(chr, known.letters.tolist())) == set("abcxyz")
    symbols = language_id._sample_symbols(short, known.symbol_tables())
    assert language_id.phrases(symbols, np.array([0, 3]), known)[0, 0] == 1


# --- token counts ---


def greedy(pieces: set[bytes], word: bytes) -> int:
    word, count = b" " + word, 0
    longest = max(map(len, pieces))
    while word:
        n = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in pieces)
        word, count = word[n:], count + 1
    return count


def test_token_counts_small_vocabulary():
    rng = random.Random(2)
    pieces = {bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc", b"bcd", b"abcdx", b"aaa", b"aaaaaab", b" ab"}
    automaton = token_counts.build(sorted(pieces))
    probes = [bytes(rng.choice(b"abcdx") for _ in range(rng.randrange(1, 30))) for _ in range(400)] + [b"a" * 500]
    data = np.frombuffer(b"".join(probes), np.uint8)
    end = np.cumsum([len(p) for p in probes])
    got = token_counts.piece_counts(data, end - [len(p) for p in probes], end, automaton)
    assert got.tolist() == [greedy(pieces, p) for p in probes]
    with pytest.raises(ValueError, match="single bytes"):
        token_counts.build([b"a"])


def test_token_counts(spark, monkeypatch):
    pieces = set(token_counts.read_vocabulary(token_counts.VOCABULARY))
    for remember in (10**6, 20):
        monkeypatch.setattr(token_counts, "REMEMBER", remember)
        docs = awkward(spark).where("length(text) < 9000 OR text IS NULL")
        out = token_counts.token_counts(docs.withColumn("n_words", F.lit("clash")))
        for r in out.collect():
            w = words(r["text"])
            assert (r["n_words"], r["n_tokens"]) == (len(w), sum(greedy(pieces, x.encode()) for x in w))
    assert token_counts.token_counts(empty(spark)).count() == 0


# --- url filter ---


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(n, p, v) for n, p, v in url_filter.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    return max(((n + p, v) for n, p, v in fits), key=lambda x: len(x[0]), default=(None, None))


def test_url_rules(spark):
    urls = [
        "http://a.com/x", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/1?q#f", "http://example.com/en/",
        "http://m.example.com/en/a", "http://x.net/es/1", "http://net/fr/2", "http://planet/fr/2", "ftp://a.com?x=/y", None,
        "", "no scheme", "http://", "http://é.org/ü#://", "http://b.org/1", "http://b.org/1", "a://b://c.com/d",
        "http://example.com/EN/", "https://x.org/" + "9" * 5000,
    ]
    pages = spark.createDataFrame([(i if i != 3 else None, u, "t") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    out = url_filter.url_filter(pages)
    got = [tuple(r)[1:5] for r in out.collect()]
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    want = collections.Counter()
    for u in urls:
        host, path = plain_host_path(u)
        want[(host, path, *plain_rule(host, path))] += 1
    open_rows = {k[:3]: n for k, n in want.items() if k[2] is None}
    assert collections.Counter(g for g in got if g[2] is not None) == {k: n for k, n in want.items() if k[2] is not None}
    assert collections.Counter(g[:3] for g in got if g[2] is None) == open_rows
    assert {g[3] for g in got} <= {"allow", "block"}
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def plain_url_scores(accepted, rejected, probes):
    """Mean log-likelihood difference of each probe, from dictionaries of all strings."""
    order, weight = url_filter.ORDER, url_filter.WEIGHT
    pad = lambda r: "\x01" * order + r + "\x01"
    seen = collections.Counter()
    for label, rows in (("allow", accepted), ("block", rejected)):
        for p in map(pad, rows):
            for i in range(order, len(p)):
                for k in range(order + 1):
                    seen[label, "s", p[i - k : i + 1]] += 1
                    seen[label, "c", k, p[i - k : i]] += 1
    out = []
    for p in map(pad, probes):
        total = 0.0
        for i in range(order, len(p)):
            for label, sign in (("allow", 1), ("block", -1)):
                q = 1 / url_filter.SYMBOLS
                for k in range(order + 1):
                    q = (seen[label, "s", p[i - k : i + 1]] + weight * q) / (seen[label, "c", k, p[i - k : i]] + weight)
                total += sign * math.log(q)
        out.append(total / (len(p) - order))
    return out


@pytest.mark.parametrize("in_place", [url_filter.IN_PLACE, 60, 0])
def test_url_model_is_a_markov_mixture(spark, in_place):
    """Exact counts of many different strings, by travelling arrays, by a shuffle, and by both."""
    rng = random.Random(7)
    made = lambda n: ["".join(rng.choice("abcdef./0~") for _ in range(rng.randrange(30))) for _ in range(n)]
    accepted, rejected, probes = [*made(60), "ab/0", "ab/0"], made(50), [*made(40), "", "ab/0", "ab/0", "zz"]
    rows = [(r, 1, "allow") for r in accepted] + [(r, 1, "block") for r in rejected] + [(r, 1, None) for r in probes]
    counted = url_filter.count_grams(spark.createDataFrame(rows, "chars string, fold int, label string"))
    ratios = url_filter.log_ratios(counted)
    given = spark.createDataFrame(list(enumerate(probes)), "row long, chars string")
    got = {r["row"]: r["score"] for r in url_filter.with_scores(given, ratios, "final", in_place).collect()}
    want = plain_url_scores(accepted, rejected, probes)
    assert np.allclose([got[i] for i in range(len(probes))], want, atol=1e-12)


def test_url_counts_grow_with_the_strings(spark):
    """Every distinct string keeps a count of its own, also beyond the size of any fixed table."""
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("chars"), F.lit(1).alias("fold"), F.lit("allow").alias("label"))
    counted = url_filter.count_grams(rows)
    want = collections.Counter()
    for r in rows.collect():
        p = "\x01" * url_filter.ORDER + r["chars"] + "\x01"
        want.update(p[i - url_filter.ORDER : i + 1] for i in range(url_filter.ORDER, len(p)))
    got = {bytes(r["gram"] >> (8 * k) & 255 for k in reversed(range(url_filter.ORDER + 1))).decode(): r["fa"] for r in counted.collect()}
    assert len(want) > 1 << 18 and got == want


def test_url_held_out_accuracy(spark):
    """URLs of a rule whose rule is hidden from the model are still judged like it."""
    hosts = ["news", "shop", "blog"]
    rows = [(i, f"http://{hosts[i % 3]}{i % 40}.example.org/{'casino/win' if i % 2 else 'docs/page'}/{i}") for i in range(400)]
    rules = tuple((f"{h}{k}.example.org", f"/{p}/", v) for h in hosts for k in range(30) for p, v in (("casino", "block"), ("docs", "allow")))
    out = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules=rules[:60])
    judged = out.where("rule IS NULL").collect()
    right = [r["verdict"] == ("block" if "casino" in r["path"] else "allow") for r in judged]
    assert len(right) > 50 and np.mean(right) > 0.95


# --- chat ---


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\0 \\\\1 \\2", "<image:0>", "", None, "\U0001f600 [x] <y> \\", "a\n</s>\nb"]
    rows = [(k % 3 if k % 5 else None, k, ["user", "assistant", None][k % 3], t, "clash") for k, t in enumerate(nasty * 6)]
    rows += [(0, 5, "user", "tie", "x"), (0, 5, "user", "tie", "x"), (9, None, "assistant", "t", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    out = chat.format_chat(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    read = out.select("conv_id", chat.read_chat(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l"))
    got = {r["conv_id"]: ([tuple(t) for t in r["t"]], r["l"]) for r in read.collect()}
    convs = collections.defaultdict(list)
    for c, k, role, t, _ in rows:
        convs[c].append((k if k is not None else -1, role or "", t or ""))
    for c, said in convs.items():
        said.sort()
        assert got[c][0] == [x[1:] for x in said]
        assert got[c][1] == [t for _, r, t in said if r == "assistant"]
    assert set(got) == set(convs)
    assert chat.format_chat(turns.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_chat_ties_go_by_the_text_as_given(spark):
    rows = [(1, 0, "user", "<a"), (1, 0, "user", "Za"), (1, 0, "user", None), (1, 0, "user", "[b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(turns.withColumn("parts", chat.text_parts(F.col("text")))).select(chat.read_chat(F.col("formatted")).alias("t"))
    assert [t.text for t in out.first().t] == ["", "<a", "Za", "[b"]


def test_chat_parts(spark):
    part = lambda kind, **m: (kind, m.get("text"), m.get("ref"), m.get("width"), m.get("height"), m.get("seconds"), m.get("pages"))
    content = [
        part("text", text="see <image:0> "), part("image", ref="a.png", width=513, height=512), part("audio", ref="b", seconds=2.5),
        part("text", text=" and ["), part("document", ref="c", pages=3), part("image"), part("video", ref="v"), part("text"), part(None, ref="n"),
    ]
    turns = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PART}")
    r = chat.format_chat(turns).first()
    flat = "see \\1image:0> <image:0><audio:1> and \\2<document:2><image:3><unknown:4><unknown:5>"
    assert r["formatted"] == f"<s>[INST] user [/INST]\n{flat}</s>\n<s>[INST] assistant [/INST]\n</s>\n"
    assert [(a["turn"], a["kind"], a["ref"], a["number"], a["tokens"]) for a in r["attachments"]] == [
        (0, "image", "a.png", 0, 340), (0, "audio", "b", 1, 75), (0, "document", "c", 2, 1800), (0, "image", None, 3, 170),
        (0, "unknown", "v", 4, 0), (0, "unknown", "n", 5, 0),
    ]
    assert r["expanded_tokens"] == 340 + 75 + 1800 + 170 and [tuple(s) for s in r["loss"]] == [(len(r["formatted"]) - 5, 0)]


# --- decontamination ---


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_lcs():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        assert decontamination.lcs(decontamination.word_places(a), len(a), b) == plain_lcs(a, b)


def leak_tables(spark):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(100)]
    talk = lambda n: [rng.choice(common) if rng.random() < 0.3 else f"t{rng.randrange(4000)}" for _ in range(n)]
    items = [talk(rng.choice([9, 16, 30, 59, 90, 150])) for _ in range(25)] + [["short", "one", "here"], []]
    docs, want = [], []
    for i in range(120):
        text, hits = talk(rng.randrange(0, 500)), set()
        if i % 2:
            k = rng.randrange(26)
            leak = list(items[k])
            if i % 4 == 1 and k < 25:
                for _ in range(len(leak) // 8):
                    leak[rng.randrange(len(leak))] = f"n{rng.randrange(10**6)}"
            at = rng.randrange(len(text) + 1)
            text = text[:at] + [w.upper() + rng.choice(["", ",", "!"]) for w in leak] + text[at:]
            hits.add(k)
        docs.append((i, " ".join(text), "clash"))
        want.append(hits)
    docs += [(200, None, None), (201, "", None), (None, " ".join(items[3]), None)]
    want += [set(), set(), {3}]
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lcs string"),
        spark.createDataFrame(bench, "item_id long, text string"), docs, items, want,
    )


@pytest.mark.parametrize("block", [2000, 9])
def test_contamination_finds_planted_passages(spark, monkeypatch, block):
    docs, bench, rows, items, want = leak_tables(spark)
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", block)
    # In so small a corpus common words weigh nearly as much as rare ones.
    out = decontamination.contamination(docs, bench, cosine=0.35)
    assert out.columns == ["doc_id", "text", "item_ids", "lcs"]
    got = {r["text"]: set(r["item_ids"]) for r in out.collect()}
    for (_, text, _), hits in zip(rows, want, strict=True):
        assert got[text] == hits


def test_contamination_against_brute_force(spark):
    """What is reported reaches the share by a plain computation, and clean texts stay clean."""
    docs, bench, rows, items, _ = leak_tables(spark)
    for r in decontamination.contamination(docs, bench).collect():
        have = [w.strip(",!") for w in (r["text"] or "").lower().split()]
        for k, item in enumerate(items):
            if len(item) >= decontamination.SHORT:
                best = plain_lcs(item, have) / len(item)
                assert (best >= 0.65) == (k in r["item_ids"])


def test_contamination_edge_cases(spark):
    docs, bench, *_ = leak_tables(spark)
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    none = decontamination.contamination(docs, bench.limit(0))
    assert none.count() == docs.count() and none.where(F.size("item_ids") > 0).count() == 0
    assert decontamination.contamination(awkward(spark), bench).count() == awkward(spark).count()


def test_many_passages_are_all_found(spark):
    """At the production cosine, beside 1,600 passages on 200 themes that fill the leading directions."""
    rng = random.Random(11)
    themes = [[f"a{t}x{j}" for j in range(40)] for t in range(200)]
    items = [[w if rng.random() < 0.9 else f"b{rng.randrange(10**6)}" for w in t] for t in themes for _ in range(8)]
    odd = [[f"c{k}x{j}" for j in range(32)] for k in range(60)]
    docs = []
    for k, words_ in enumerate(odd):
        text, leak = [rng.choice(rng.choice(themes)) for _ in range(200)], list(words_)
        for at in rng.sample(range(32), 6 * (k % 2)):
            leak[at] = f"n{rng.randrange(10**6)}"
        at = rng.randrange(len(text))
        docs.append((k, " ".join(text[:at] + leak + text[at:])))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(odd + items)], "item_id long, text string").coalesce(1)
    out = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    found = {r["doc_id"] for r in out.collect() if r["doc_id"] in r["item_ids"]}
    exact, changed = (sum(k % 2 == odd_one for k in found) for odd_one in (0, 1))
    assert (exact, changed) == (30, 30)


def test_answers_must_stand_in_the_text(spark):
    question = prose(20)
    docs = spark.createDataFrame([(1, f"x {question} the answer is blue."), (2, f"x {question} no more")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, question, "Blue")], "item_id long, text string, answer string")
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.contamination(docs, bench, answer_col="answer").collect()}
    assert got == {1: [7], 2: []}


# --- segmentations ---


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_sampling.read_model()


def encode(texts, keys, samples, v):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    coded, log_probs, inclusion = sentencepiece_sampling.encode_block(data, offsets, keys, samples, v, sentencepiece_sampling.Known())
    return [[tuple(ids[f[i] : f[i + 1]].tolist()) for ids, f in coded] for i in range(len(texts))], log_probs, inclusion


def all_segmentations(unit: bytes, v) -> dict[tuple, float]:
    by_surface = {s: i for i, s in enumerate(v.surface) if s and i not in set(v.byte_piece.tolist())}
    out = {}

    def go(at, ids, score):
        if at == len(unit):
            out[tuple(ids)] = score
        for end in range(at + 1, len(unit) + 1):
            if unit[at:end] in by_surface:
                i = by_surface[unit[at:end]]
                go(end, [*ids, i], score + v.score[i])

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: s - total for k, s in out.items()}


def test_lattice_distribution_is_exact(vocabulary):
    n, text = 6000, "abc the"
    exact = {}
    for (a, p), (b, q) in itertools.product(all_segmentations(b" abc", vocabulary).items(), all_segmentations(b" the", vocabulary).items()):
        exact[a + b] = p + q
    got, log_probs, inclusion = encode([text] * n, mix(np.arange(n, dtype=np.uint64)), 3, vocabulary)
    for i in range(0, n, 50):
        assert len(set(got[i])) == 3
        for j in range(3):
            assert math.isclose(log_probs[j, i], exact[got[i][j]], abs_tol=1e-8)
    first = collections.Counter(g[0] for g in got)
    second = collections.Counter((g[0], g[1]) for g in got)
    top = sorted(exact, key=exact.get)[-3:]
    for a in top:
        p = math.exp(exact[a])
        assert abs(first[a] / n - p) < 4 * math.sqrt(p / n)
        for b in top:
            if a != b:
                q = p * math.exp(exact[b]) / (1 - p)
                assert abs(second[a, b] / n - q) < 4 * math.sqrt(q / n) + 1e-3
    # Weighted by their inclusion scores, the sampled probabilities sum to one on average.
    assert abs((np.exp(log_probs) / inclusion).sum(0).mean() - 1) < 0.02


def test_all_segmentations_of_a_small_space(vocabulary):
    want = all_segmentations(b" the", vocabulary)
    got, _, inclusion = encode(["the"], np.array([5], np.uint64), len(want) + 3, vocabulary)
    assert set(got[0][: len(want)]) == set(want) and (inclusion[: len(want), 0] == 1).all()


def test_deep_subtrees_are_drawn_when_needed(vocabulary, monkeypatch):
    text, keys = [prose(30)], np.array([3], np.uint64)
    want = encode(text, keys, 4, vocabulary)
    monkeypatch.setattr(sentencepiece_sampling, "DEPTH", 1e9)
    assert encode(text, keys, 4, vocabulary)[0] == want[0]
    monkeypatch.setattr(sentencepiece_sampling, "DEPTH", 1.0)
    assert encode(text, keys, 4, vocabulary)[0] == want[0]


def test_segmentation_rows(spark):
    docs = awkward(spark)
    out = sentencepiece_sampling.sample_segmentations(docs, samples=3)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    for r in rows:
        s = r["segmentations"]
        assert (len(s) == 0) == (r["text"] is None) and len({bytes(x["ids"]) for x in s}) == len(s)
        assert all(len(x["ids"]) == 4 * x["n_pieces"] and 0 <= x["inclusion"] <= 1 for x in s)
    again = sentencepiece_sampling.sample_segmentations(docs.repartition(5), samples=3)
    key = lambda rs: sorted(str((r["doc_id"], r["text"], r["segmentations"])) for r in rs)
    assert key(rows) == key(again.collect())
    assert sentencepiece_sampling.sample_segmentations(empty(spark)).count() == 0
    coded = out.where("text IS NOT NULL").select("text", F.explode("segmentations.ids").alias("ids"))
    assert sentencepiece_sampling.decode_ids(coded).where("text <> decoded").count() == 0
