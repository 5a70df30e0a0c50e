import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from compare import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from kinemetry.llm import byte_bpe, chat_format, common, embedding_dedup, html_extract, language_id, line_dedup, packing, pretokens, quality_rules, queries, simhash, token_counts

TIK, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "don't  we'LL 's", "é中文 \U0001f600", "x" * 3000, "ab " * 2000, "<|endoftext|> <|im_start|>", "7 7 7"]


def docs(spark, texts):
    rows = [(i, t, "extra", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, score double")


@pytest.fixture(scope="module")
def tik():
    with open(TIK, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=2000):
    r = random.Random(5)
    return ["".join(r.choice("ab 's't're\n\t don'tll éü中 12٣ \U0001f600!? '") for _ in range(r.randrange(40))) for _ in range(n)]


def test_bpe_is_tiktokens(tik):
    texts = [t or "" for t in ODD] + odd_texts()
    for v in (byte_bpe.from_ranks(TIK), byte_bpe.from_json(JSON)):
        ids, n = byte_bpe.encode(v, texts)
        assert ids.tolist() == [i for t in texts for i in tik.encode_ordinary(t)]
        data, size = byte_bpe.decode(v, ids, n)
        assert data.tobytes().decode() == "".join(texts) and size.sum() == len(data)


def test_bpe_query(spark, data, tik):
    got = {r.doc_id: r for r in queries.op9_byte_bpe(spark, data).collect()}
    for r in common.table(spark, data, "documents").collect():
        ids = tik.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_bpe_columns(spark):
    got = byte_bpe.with_text(byte_bpe.with_ids(docs(spark, ODD), TIK), TIK).collect()
    assert [bytes(r.decoded).decode() for r in got] == [t or "" for t in ODD]


def test_packing(spark, data):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in common.table(spark, data, "documents").collect()}
    ids = {d: t.encode(x, add_special_tokens=False).ids + [0] for d, x in texts.items()}
    rows = queries.op6_packing(spark, data).collect()
    seen, used = {d: 0 for d in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == seen[r.doc_id] and r.length == len(own) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        seen[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(seen[d] == len(x) for d, x in ids.items())
    sizes = []
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= 1024 and all(s & (s - 1) == 0 for s in sizes)  # full, or a power of two


def test_fill_is_the_best_subset():
    r = random.Random(1)
    for _ in range(300):
        items = [r.randrange(1, 30) for _ in range(r.randrange(0, 9))]
        room, counts, bits = r.randrange(0, 60), [0] * 64, 0
        for x in items:
            counts[x] += 1
            bits |= 1 << x
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= room}
        got = packing.fill(room, counts, bits)
        assert sum(x * n for x, n in got) == max(sums) and all(n <= counts[x] for x, n in got)


def test_token_counts_are_the_unigram_tokenizers(spark):
    c = token_counts.from_sentencepiece(public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    low = min(p.get_score(i) for i in range(259, p.vocab_size()))
    vocab = [("<unk>", low)] + [(p.id_to_piece(i), low if i < 259 else p.get_score(i)) for i in range(1, p.vocab_size())]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    texts = [x or "" for x in ODD if x is None or "<|" not in x] + odd_texts(500)
    want = [len(t.encode("▁" + x.replace(" ", "▁") if x else "", add_special_tokens=False).ids) for x in texts]
    assert c.counts(texts).tolist() == want
    assert [r.n_tokens for r in token_counts.with_counts(docs(spark, texts[:12]), public_tokenizers.path("piece_bpe_32k.model")).collect()] == want[:12]


def test_token_counts_query_is_the_files_tokenizer(spark, data):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r.doc_id: r.text or "" for r in common.table(spark, data, "documents").collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op5_token_counts(spark, data).collect()} == {d: len(p.encode(t)) for d, t in texts.items()}
    known = {"the": 1, "the house is on the hill and the device is on": 11, "information technology and the government of the people": 8}
    got = token_counts.with_merge_counts(docs(spark, [*known, *ODD]), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [*known.values(), *(len(p.encode(t or "")) for t in ODD)] and got[0].fp == "extra"
    assert token_counts.with_merge_counts(docs(spark, ODD).limit(0), path).count() == 0


def test_fingerprints():
    def brute(text):
        w = bytes(ord(c) + 32 if 65 <= c_ <= 90 else c_ for c, c_ in ((chr(b), b) for b in text.encode())).split()
        if not w:
            return 0
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    for t in [x or "" for x in ODD] + ["The cat SAT on É mat " * 9]:
        assert simhash.fingerprint(t.encode()) == brute(t)


def test_golay_keys_meet():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 2):
        b = a.copy()
        for i in range(len(b)):
            for k in r.choice(64, n, replace=False):
                b[i] ^= np.uint64(1 << int(k))
        ka, na = simhash.keys(a.view(np.int64))
        kb, nb = simhash.keys(b.view(np.int64))
        ka, kb = np.split(ka, np.cumsum(na)[:-1]), np.split(kb, np.cumsum(nb)[:-1])
        assert all(set(x) & set(y) for x, y in zip(ka, kb, strict=True)) and na.max() <= 18


def test_links_join_what_brute_force_joins(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = {0, *base}
    for _ in range(120):  # a crowd around one value: more than are compared pair by pair
        fps.add(base[0] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(8)))
    for b in base[1:]:
        fps.add(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
        fps.add(b ^ 7)
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {x.id: x.component for x in common.components(simhash.links(df)).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if bin((x ^ y) & (1 << 64) - 1).count("1") <= 2:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    assert {x: got.get(x, x) for x in fps} == {x: find(x) for x in fps}


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, data, name):
    same(queries.queries()[name](spark, data), queries.oracle_sql()[name], data)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, 0.0], None), (8, [2.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.link(df).collect())
    assert got == [(0, 3, 0), (1, 3, 0), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 3, 0), (8, 3, 0), (9, 0, 9)]
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_line_dedup_odd_rows(spark):
    line = "one two three four five six"
    rows = [(2, line, 0), (1, f"{line}\nTWO one three four five six\nshort line\nshort line", 0), (None, line, 0), (3, None, 0), (4, "", 0), (5, "seven two three four five six nine ten", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup(df).collect()}
    assert got[1] == (f"{line}\nshort line", 4, 2) and got[2] == ("", 1, 1)
    assert got[None] == (line, 1, 0) and got[3] == (None, 0, 0) and got[4] == ("", 1, 0) and got[5][2] == 0
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_line_dedup_of_lines_of_few_words(spark):
    r = random.Random(3)
    texts = ["\n".join(" ".join(r.choice("abcdefg") for _ in range(r.randrange(0, 8))) for _ in range(r.randrange(1, 12))) for _ in range(40)]
    texts += ["so\nSO so\n \n\n \nno", "p q r s t\nq p s r\nq p s\np q s r t u"]
    earlier, want = [], []
    for t in texts:
        kept, lines = [], t.split("\n")
        for line in lines:
            s = set(line.lower().split())
            if not s or not any(5 * len(s & e) >= 4 * len(s | e) for e in earlier):
                kept.append(line)
            earlier.append(s)
        want.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    assert want[-2][0] == "so\n \n\n \nno" and want[-1][0] == "p q r s t\nq p s"
    assert [(x.text, x.n_lines, x.n_removed) for x in line_dedup.dedup(docs(spark, texts)).orderBy("doc_id").collect()] == want


def test_line_dedup_meets_in_one_exchange(spark):
    # the two sides of the index read one exchange of its rows; they had one each, and both were on disk at once
    sets = line_dedup._sets(docs(spark, ["a b c d e f", "a b c d e f g"]).withColumnRenamed("doc_id", "doc")).withColumn("there", F.col("at") > 0)
    was = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = line_dedup._meetings(sets)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was[1])
    assert "SortMergeJoin" in plan and "ReusedExchange" in plan


def test_line_dedup_meets_by_one_number(spark):
    # rows of the index are sorted by one whole number, word and octave together; they had two keys, and Spark compared whole rows
    sets = line_dedup._sets(docs(spark, ["a b c d e f", "a b c d e f g"]).withColumnRenamed("doc_id", "doc")).withColumn("there", F.col("at") > 0)
    index = line_dedup._meetings(sets)._jdf.queryExecution().optimizedPlan().toString()
    assert "(key#" in index and "octave#" not in index.split("Join Inner")[1].split("\n")[0]


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_line_dedup_of_groups_above_the_limit(spark, monkeypatch, hot):
    # lines that vary around a few, held against the earliest at any limit; and long ones, with all parity bits
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(hot)
    bases = [[f"w{r.randrange(3000)}" for _ in range(k)] for k in (6, 9, 20, 40, 100, 200)]
    texts = []
    for _ in range(40):
        lines = []
        for base in bases:
            line = list(base)
            for _ in range(r.randrange(0, 2 + len(base) // 6)):
                line[r.randrange(len(line))] = f"x{r.randrange(10**6)}"
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    earlier, want = [], []
    for t in texts:
        kept = []
        for line in t.split("\n"):
            s = set(line.split())
            if not any(5 * len(s & e) >= 4 * len(s | e) for e in earlier):
                kept.append(line)
            earlier.append(s)
        want.append("\n".join(kept))
    assert [x.text for x in line_dedup.dedup(docs(spark, texts)).orderBy("doc_id").collect()] == want


def test_line_dedup_hot_words_are_those_of_like_lines(spark, monkeypatch):
    # a word in many prefixes is held against the earliest line only where lines are of one size; it was wherever it stood
    monkeypatch.setattr(line_dedup, "HOT", 32)
    spread = [" ".join(["rare", *(f"w{k}x{i}" for i in range(2 * k))]) for k in range(4, 44)]
    alike = [" ".join(["often", *(f"v{k}x{i}" for i in range(9))]) for k in range(200)]
    for texts, some in ((spread, False), (alike, True)):
        sets = spark.createDataFrame([(k, 0, len(t.split()), 0, None, [0, 1 + k]) for k, t in enumerate(texts)], "doc long, at int, n int, b long, c long, prefix array<int>")
        assert line_dedup._hot(sets).isEmpty() != some


def test_line_dedup_meets_over_the_bounds_of_sizes(spark):
    # lines of 4/5 of each other's words on either side of a power of two, in both orders; lines two octaves apart don't meet
    texts, want = [], []
    for k, (small, large) in enumerate([(7, 8), (13, 16), (14, 17), (26, 32), (15, 16), (52, 65), (51, 64)]):
        words = [f"s{k}x{i}" for i in range(large)]
        pair = [" ".join(words[:small]), " ".join(words)]
        texts += pair[:: -1 if k % 2 else 1]
        want += [0, int(5 * small >= 4 * large)]
    got = [r.n_removed for r in line_dedup.dedup(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == want and 0 in want[1::2] and 1 in want[1::2]
    sets = spark.createDataFrame([(0, 0, 5, 0, None, [9], False), (1, 0, 40, 0, None, [9], False)], "doc long, at int, n int, b long, c long, prefix array<int>, there boolean")
    assert line_dedup._meetings(sets).isEmpty()


def test_line_dedup_in_any_order_of_words(spark, monkeypatch):
    # rarity is counted in some documents only; the result doesn't depend on which
    r = random.Random(8)
    texts = ["\n".join(" ".join(r.choice("abcdefghijkl") for _ in range(r.randrange(4, 20))) for _ in range(6)) for _ in range(30)]
    whole = [tuple(x) for x in line_dedup.dedup(docs(spark, texts)).orderBy("doc_id").collect()]
    monkeypatch.setattr(line_dedup, "COUNTED", 3)
    assert [tuple(x) for x in line_dedup.dedup(docs(spark, texts)).orderBy("doc_id").collect()] == whole


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "", None, "<\\|x <\\\\| <|", "é\n\U0001f600", "<", "|im_end|>"]
    rows = [(i % 3, i, ("user", "assistant", "a\nb\\<|")[i % 3], t) for i, t in enumerate(texts)] + [(None, 0, None, "x"), (2, 1, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat_format.conversations(df)
    for r in formatted.collect():
        own = sorted(((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id))
        raw = r.formatted.encode()
        assert [(a.decode(), b.decode()) for a, b in chat_format.parse(raw)] == [(x[1], x[2]) for x in own]
        assert [chat_format.unescape(raw[a:b]).decode() for a, b in zip(r.loss_starts, r.loss_ends, strict=True)] == [x[2] for x in own if x[1] == "assistant"]
    assert chat_format.read_back(formatted).count() == 4
    assert chat_format.conversations(df.limit(0)).count() == 0


def test_html():
    page = ('<html><head><title>t</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div><article><h1>T &amp; x</h1><p><b>A  b<br>c<p>1 &lt; 2'
            '<form><p>no</p></form><section class="comments"><p>me</p></section></article><footer>f</footer><script>"</p>"</script>')
    assert html_extract.main_text(html_extract.lines(page), None) == "T & x\nA b c\n1 < 2"
    a = html_extract.lines("<div>Site</div><div>own text of a, rather long</div><div>End</div>")
    b = html_extract.lines("<div>Site</div><div>other text</div><div>End</div>")
    assert html_extract.main_text(a, b) == "own text of a, rather long"
    assert html_extract.main_text(a, a) == "Site\nown text of a, rather long\nEnd"
    assert html_extract.lines("") == []


def test_html_words_in_names_drop_no_article():
    of = lambda page: html_extract.main_text(html_extract.lines(page), None)
    body = "<p>The first paragraph of the article itself.</p><p>And one more that is long enough.</p>"
    want = "The first paragraph of the article itself.\nAnd one more that is long enough."
    assert of(f'<nav>Menu</nav><article class="post hentry comment-open">{body}</article><footer>End</footer>') == want
    assert of(f'<div class="content has-sidebar"><article>{body}</article><div class="sidebar">Links</div></div>') == want
    assert of(f'<div class="content has-sidebar"><div id="menu">Menu</div><main>{body}</main></div><p>Imprint</p>') == want
    assert of(f'<article>{body}<p class="share-price">The price rose.</p><blockquote class="alert">Said aloud.</blockquote><div class="share">Share</div></article>') == want + "\nThe price rose.\nSaid aloud."
    # comments and teasers that call themselves articles stay out, beside an article and beside unmarked text
    teasers = '<div class="related"><article>Read this too</article></div><ol class="comment-list"><li><article class="comment">I agree</article></li></ol>'
    assert of(f"<article>{body}</article>{teasers}") == want and of(f"<div>{body}</div>{teasers}") == want
    assert of(f'<aside><article>{body}</article></aside><p>Own text.</p>') == "Own text."


def test_html_references_are_of_one_text_node():
    of = lambda page: html_extract.main_text(html_extract.lines(page), None)
    assert of("<p>AT&<b>amp;</b>T</p>") == "AT&amp;T" and of("<p>a&<!-- x -->lt;b &lt;c&gt; &amp;lt;</p>") == "a&lt;b <c> &lt;" and of("<p>x <![CDATA[1 &lt; 2]]></p>") == "x 1 &lt; 2"


def test_html_rows(spark):
    rows = [(1, "http://h/a/1", "<p>x</p>"), (2, None, None), (3, "h", "<p>"), (1, "http://h/a/1", "<p>x</p>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == [(1, "x", 1), (1, "x", 1), (2, "", 0), (3, "", 0)]


def test_quality_counts():
    def brute(text):
        w = text.split(" ")
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({j for i, x in enumerate(win) if win.count(x) > 1 for j in range(i, i + 3)})

    r = random.Random(0)
    for _ in range(200):
        t = " ".join(r.choice("abc") for _ in range(r.randrange(1, 30)))
        assert quality_rules.repeated_words(t.encode().split()) == brute(t)


def test_quality_rows(spark):
    got = quality_rules.assess(docs(spark, [*ODD, "a#b\nc é\n\na#b\n"])).collect()
    assert all(not r.kept for r in got) and got[0].n_words == 0
    assert (got[-1].n_words, got[-1].word_chars, got[-1].n_symbols, got[-1].n_dup_lines) == (4, 8, 2, 1)
    r = random.Random(1)
    prose = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(400))
    noise = base64.b64encode(r.randbytes(3000)).decode()
    a, b = quality_rules.assess(docs(spark, [prose, " ".join(noise[i : i + 40] for i in range(0, len(noise), 40))])).collect()
    assert a.kept and a.ratio < b.ratio


def test_languages_held_out(spark, data):
    truth = {r.doc_id: r.lang for r in common.table(spark, data, "documents").collect()}
    got = [r for r in queries.op1_language_id(spark, data).collect() if r.held_out]
    assert len(got) > 20 and sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.93 * len(got)
    models = language_id.fit(common.table(spark, data, "documents"))
    odd = language_id.predict(docs(spark, [None, "", "12 $", "The of and"]), models).collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and odd[3].lang_pred in models.languages and odd[3].fp == "extra"


def test_language_rejection_rejects_noise_and_keeps_texts(spark, data):
    r = random.Random(1)
    table = common.table(spark, data, "documents")
    models = language_id.fit(table)
    real = [x.text for x in table.where("length(text) > 300").limit(40).collect()]

    def shuffled(t):
        return "".join(r.sample(t, len(t)))

    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (120, 300, 1000) for _ in range(10)]
    noise += ["".join(r.choice("абвгдежзийклмнопрстуфх    ") for _ in range(300)) for _ in range(10)]
    noise += [" ".join(r.choice(["привет", "世界", "hello", "κόσμε", "the", "und"]) for _ in range(60)) for _ in range(10)]
    noise += ["".join(r.choice("asdfjkl ") for _ in range(300)) for _ in range(10)]
    got = language_id.label(models, noise + [shuffled(t[:1000]) for t in real]).to_pylist()
    assert all(x["rejected"] for x in got[:60]) and sum(x["rejected"] for x in got[60:]) >= 0.85 * len(real)
    own = language_id.label(models, [x.text for x in table.collect()]).to_pylist()
    assert sum(x["rejected"] for x in own if x["cross_entropy"] is not None) <= 0.01 * len(own)


def test_models_are_distributions():
    texts = ["abab abba baab ", "bbb aab ab "]
    sym, at = language_id._letters(texts)
    counts = {}
    for n in range(1, language_id.ORDER + 1):
        key = language_id._keys(sym, at, n)
        if n < language_id.ORDER:
            key = key[at[:-1] + n - 1]
        counts["x", n] = np.unique(key[key >= 0], return_counts=True)
    m = language_id._kneser_ney(["x"], counts)
    letters = sorted(set(sym.tolist()))
    for ctx in ([ord("a"), ord("b"), ord("b")], [ord("b"), ord("b"), ord("b")]):
        p = sum(np.exp(m.letters(np.array([*ctx, c], np.uint16), np.array([0, 4]))[-1, 0]) for c in letters)
        assert 0.8 < p <= 1.0001


def test_pretokens_are_the_patterns():
    import regex

    texts = [t or "" for t in ODD] + odd_texts()
    w = pretokens.split(texts)
    got = [w.words[int(c)].as_py().decode() for c in w.code]
    assert got == [x for t in texts for x in regex.findall(public_tokenizers.PATTERN, t)]


def test_pipeline(spark, data):
    import corpus_pipeline

    docs_in = common.table(spark, data, "documents")
    assert corpus_pipeline.run(spark, data).count() > 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs_in, data).columns == docs_in.columns


def test_arrow_results_of_empty_batches():
    assert len(language_id.label(None, [])) == 0 and isinstance(pa.array([]), pa.Array)


def test_quality_query_is_brute_force(spark, data):
    import collections
    import re

    import zstandard

    word = re.compile(r"[^\x20\x09-\x0d]+")
    rows = common.table(spark, data, "documents").collect()
    got = {r.doc_id: r for r in queries.op10_quality_rules(spark, data).collect()}
    seen, base = collections.defaultdict(list), {}
    for r in rows:
        t, g = r.text or "", got[r.doc_id]
        w = word.findall(t)
        win = collections.Counter(zip(w, w[1:], w[2:]))
        rep = len({j for i, x in enumerate(zip(w, w[1:], w[2:])) if win[x] > 1 for j in range(i, i + 3)})
        own = [x for x in t.split("\n") if word.search(x)]
        base[r.doc_id] = len(w) < 50 or 100 * rep > 50 * len(w)
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), rep, base[r.doc_id])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == want
        b = t.encode()
        if b:
            assert g.ratio == len(zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress(b)) / len(b)
        if not base[r.doc_id]:
            seen[quality_rules.length_class(len(b))].append(int(g.ratio * 1000))
    for r in rows:  # the whole text's limits, from the sorted ratios of its length; chunks decide beside them
        g, size = got[r.doc_id], len((r.text or "").encode())
        ratios = sorted(seen[quality_rules.length_class(size)])
        inside = True
        if ratios and size >= 256:
            low, mid, high = ((ratios[-(-len(ratios) * k // 4) - 1] + 0.5) / 1000 for k in (1, 2, 3))
            own = mid - 4 * max(mid - low, 0.001) / 0.6745, mid + 4 * max(high - mid, 0.001) / 0.6745
            fixed = next(b[1:] for b in reversed(quality_rules.BANDS) if size >= b[0])
            far = len(ratios) ** 2 / (len(ratios) ** 2 + 30**2)
            inside = far * own[0] + (1 - far) * fixed[0] <= g.ratio <= far * own[1] + (1 - far) * fixed[1]
        assert g.kept == (not base[r.doc_id] and inside and quality_rules.in_band(g.ratio, size) and g.bad_chunks <= quality_rules.BAD_CHUNKS)


def test_quality_limits_have_no_step_in_size():
    counts = {450: 10, 460: 20, 470: 10}
    far = [quality_rules.bounds({k: v * n for k, v in counts.items()}) for n in range(1, 60)]
    assert len({b[:2] for b in far}) == 1 and all(0 < b[2] - a[2] < 0.25 for a, b in zip(far, far[1:], strict=False))
    one = quality_rules.bounds({450: 1})
    assert one[2] < 0.01 and quality_rules.in_band(0.3, 2000, one) and quality_rules.in_band(0.7, 2000, one) and not quality_rules.in_band(0.1, 2000, one)
    assert not quality_rules.in_band(0.3, 2000, far[-1]) and quality_rules.in_band(0.46, 2000, far[-1]) and not quality_rules.in_band(0.9, 2000, (0.0, 1.0, 1.0))


def test_quality_bands_reject_planted_texts(spark):
    r = random.Random(7)
    letters = "etaoinshrdlu"
    vocab = ["".join(r.choice(letters) for _ in range(r.randrange(2, 10))) for _ in range(3000)]
    clean = [" ".join(r.choice(vocab) for _ in range(r.randrange(200, 500))) for _ in range(900)]
    marked = [" ".join(r.choice(vocab) + r.choice(("***", "$$$", "|")) for _ in range(260)) for _ in range(10)]
    few = [" ".join(r.choice(vocab[:12]) for _ in range(300)) for _ in range(10)]
    noise = [" ".join(base64.b64encode(r.randbytes(5)).decode() for _ in range(230)) for _ in range(10)]
    got = [x.kept for x in quality_rules.assess(docs(spark, clean + marked + few + noise)).orderBy("doc_id").collect()]
    assert sum(got[:900]) >= 890 and not any(got[900:])
    assert quality_rules.assess(docs(spark, clean).limit(0)).count() == 0
    twice = quality_rules.assess(docs(spark, [None, "", clean[0], clean[0], "x y " * 200000]).withColumn("kept", F.lit(1)))
    assert [x.kept for x in twice.orderBy("doc_id").collect()] == [False, False, True, True, False] and twice.columns.count("kept") == 1


def text_of(page, near=None):
    return html_extract.main_text(html_extract.lines(page), near and html_extract.lines(near))


def test_html_without_end_tags():
    assert text_of("<html><head><title>t</title><meta charset=x><body><article><p>A<p>B</article>") == "A\nB"
    assert text_of("<head><title>t</title><p>A") == "A" and text_of("<head>A") == "A"
    assert text_of("<article><p class='ad'>Buy<div>Main</div></article>") == "Main"
    assert text_of("<article><ul><li class='ad'>Buy<li>Main</ul><dl><dt class='ad'>x<dd>y</dl></article>") == "Main\ny"
    assert text_of("<article><table><tr><td class='ad'>Buy<td>Main<tr><td>More</table></article>") == "Main\nMore"
    assert text_of("<main><article><p>Short</p></article><p>The long text of the main part</p></main>") == "Short\nThe long text of the main part"
    assert text_of("<main><p>Crumb</p><article><p>The long text of the article</p></article></main>") == "The long text of the article"
    assert text_of("<article><div class='article-header'><h1>Head</h1></div><p>Text</p></article>") == "Head\nText"
    assert text_of("<article><svg><svg><text>no</text></svg><text>no</text></svg><p>Text</p></article>") == "Text"
    assert text_of("<article><p>a<script>if (x < 1) '<p>no'</script>b</article>") == "ab".replace("ab", "a b")


def test_html_common_is_the_longest():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = sorted(html_extract.common(a, b))
        assert len(got) == table[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_html_does_not_depend_on_partitions(spark):
    rows = [(i, f"http://h/{'a' if i < 9 else 'b'}/{i:02d}", f"<div>Site of all pages</div><div>own {i} " + f"word{i} " * 9 + "</div><div>End of all pages</div>") for i in range(15)]
    rows += [(20 + i, f"http://g/{i}", f"<article>x{i}</article>") for i in range(5)] + [(50, "http://alone/", "<p>alone</p>"), (51, None, None)]
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "4", "211"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted((r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(rows)
    assert all(t == f"own {i} " + " ".join([f"word{i}"] * 9) for i, t in seen[0][:15])
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_extract.extract(empty).columns == ["page_id", "url", "text", "n_chars"] and html_extract.extract(empty).count() == 0


def test_chat_query_is_brute_force(spark, data):
    rows = [tuple(r) for r in common.table(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.CONTROL), (-1, 1, "assistant", queries.CONTROL)]
    got = {r.conv_id: r for r in queries.op7_chat_format(spark, data).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, role, text or ""))
    assert set(got) == set(by)
    bar = lambda x: x.replace("<|", "<\\|")  # noqa: E731  none of these texts has backslashes before a bar
    for c, turns in by.items():
        turns, g = [x[1:] for x in sorted(turns)], got[c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert not any("<\\" in t for _, t in turns)
        shown = "".join(f"<|im_start|>{r}\n{bar(t)}<|im_end|>\n" for r, t in turns)
        assert (g.n_turns, g.loss_chars, g.formatted_chars) == (len(turns), len(loss), len(shown))
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_of_many_batches(spark):
    rows = [(i // 7, i, ("user", "assistant")[i % 2], f"text {i} " * (i % 50)) for i in range(700)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    got = chat_format.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 100
    for r in got:
        raw, own = r.formatted.encode(), rows[r.conv_id * 7 : r.conv_id * 7 + 7]
        assert [(a.decode(), b.decode()) for a, b in chat_format.parse(raw)] == [x[2:] for x in own]
        assert [raw[a:b].decode() for a, b in zip(r.loss_starts, r.loss_ends, strict=True)] == [x[3] for x in own if x[2] == "assistant"]


def test_simhash_query_is_brute_force(spark, data):
    rows = common.table(spark, data, "documents").select("doc_id", "text").collect()
    fp = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in rows}
    ids, root = sorted(fp), {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, data).collect()}
    assert got == {d: (f"{fp[d]:016x}", find(d)) for d in ids}


def test_simhash_firsts_of_odd_rows(spark):
    a, b = "one two three four five six seven", "some quite other words stand in here"
    rows = [(3, a), (1, a), (1, a), (None, b), (None, b), (7, None), (8, ""), (9, "alone among all of these words")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.text) for r in simhash.firsts(df).collect()), key=str)
    assert got == sorted([(1, a), (None, b), (7, None), (9, rows[-1][1])], key=str)
    assert simhash.firsts(df).columns == df.columns and simhash.firsts(df.limit(0)).count() == 0
    assert {(r.doc_id, r.component_id) for r in simhash.groups(df).collect()} == {(3, 1), (1, 1), (None, None), (7, 7), (8, 7), (9, 9)}


def test_languages_of_nothing(spark):
    empty = docs(spark, ["x"]).limit(0).withColumn("lang", F.lit("en"))
    models = language_id.fit(empty)
    assert models.languages == [] and language_id.predict(empty, models).count() == 0
    assert [r.lang_pred for r in language_id.predict(docs(spark, ["some words", None]), models).collect()] == ["und", "und"]
    one = language_id.fit(docs(spark, ["some few words"]).withColumn("lang", F.lit("en")))
    got = language_id.predict(docs(spark, ["some few words", "x" * 300_000]).withColumn("lang_pred", F.lit(1)), one).collect()
    assert one.languages == ["en"] and [r.lang_pred for r in got] == ["en", "en"]


def test_line_dedup_clashing_names(spark):
    df = docs(spark, ["a b c d e f\na b c d e f", "x\n\ny"]).selectExpr("doc_id", "text", "1 as _doc", "2 as _ats", "3 as _parts", "4 as n_lines")
    got = [tuple(r) for r in line_dedup.dedup(df).orderBy("doc_id").collect()]
    assert got == [(0, "a b c d e f", 1, 2, 3, 2, 1), (1, "x\n\ny", 1, 2, 3, 3, 0)]
