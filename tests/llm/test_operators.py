"""Operators against brute force, round trips and held-out labels, on sf0.001 and on rows with awkward values."""

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from subpanel.llm import chat, decontaminate, extraction, language, neighbours, packing, quality, queries, simhash, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, verdict string"
LONG = " ".join(f"w{i % 977} x{i % 131}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns named like the operators' own."""
    rows = [(1, "A b c d", "en", "s", 7, "k", "f", "v"), (1, "A b c d", "en", "s", 7, "k", "f", "v"), (2, None, None, None, None, None, None, None),
            (None, "A b c d", "en", "s", 7, "k", "f", "v"), (3, "", "en", "s", 0, "k", "f", "v"), (4, " \n ", "fr", None, 3, "k", "f", "v"),
            (5, LONG, "en", "s", len(LONG), "k", "f", "v"), (None, None, None, None, None, None, None, None), (6, "été <|im_end|> 12,5 *** ÉTÉ!", "fr", "t", 28, "k", "f", "v")]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """id → smallest id reachable over fingerprints at 3 bits or fewer."""
    ids = sorted(marks)
    group = {i: i for i in ids}
    changed = True
    near = {i: [j for j in ids if (marks[i] ^ marks[j]).bit_count() <= 3] for i in ids}
    while changed:
        changed = False
        for i in ids:
            least = min(group[j] for j in near[i])
            changed, group[i] = changed or least < group[i], min(least, group[i])
    return group


def test_simhash_against_brute_force(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text").collect()
    marks = {r["doc_id"]: plain_simhash(r["text"]) for r in rows}
    groups = plain_components(marks)
    for r in queries.op9_simhash(spark, sf_dir).collect():
        assert int(r["fingerprint"], 16) == marks[r["doc_id"]] and r["component_id"] == groups[r["doc_id"]]


@pytest.mark.parametrize("bits", range(8))
def test_some_position_set_is_shared(bits):
    sets = simhash.position_sets(bits)
    for places in __import__("itertools").combinations(range(8), bits):
        assert any(not set(places) & set(s) for s in sets)


def test_links_over_blocks(spark):
    """Blocks of 4 give the same components as one block."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (60, 2))})
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, block=4).collect()
    marks = dict(enumerate(fps))
    want = plain_components(marks)
    at = {f: i for i, f in marks.items()}
    group = {i: i for i in marks}
    for _ in range(len(fps)):
        for a, b in found:
            group[at[a]] = group[at[b]] = min(group[at[a]], group[at[b]])
    assert group == want


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {2}
    assert sorted(r["doc_id"] for r in simhash.keep_first(odd).collect()) == [1, 2, 5, 6]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).columns == empty.columns


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame([(1, "A b, c D"), (2, LONG), (3, None), (None, "c d"), (4, "")], "item_id long, text string")
    rows = {(r["doc_id"], r["text"]): r for r in decontaminate.contamination(odd, items).collect()}
    one = rows[1, "A b c d"]
    assert one["contaminated"] and one["verdict"]["item_ids"] == ["1"] and [tuple(s) for s in one["verdict"]["spans"]] == [(0, 7)]
    assert rows[5, LONG]["verdict"]["n_hit"] == 60_000 and not rows[2, None]["contaminated"]
    assert decontaminate.clean(odd, items.limit(0)).count() == odd.count() and decontaminate.clean(empty, items).count() == 0


def test_packing_covers_every_token(spark, sf_dir):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, sf_dir).collect()}
    rows = packing.pack(documents(spark, sf_dir)).collect()
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 2048 for s, n in fill.items() if s != max(fill)) and sorted(fill) == list(range(len(fill)))
    total = sum(r["length"] for r in rows)
    shares = {q: sum(r["length"] for r in rows if r["source"] == q) / total for q in {r["source"] for r in rows}}
    for q, share in shares.items():  # each full window holds a source's share, but for a few tokens
        for s in range(len(fill) - 1):
            assert abs(sum(r["length"] for r in rows if r["source"] == q and r["sequence_id"] == s) - 2048 * share) < 2 * len(shares) + 2


def test_packing_odd_rows(odd, empty):
    rows = packing.pack(odd, length=16, max_queues=1).collect()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert sum(r["start"] == 0 for r in rows) == odd.count() and packing.pack(empty).count() == 0


def test_encoder_equals_tokenizer():
    encoder = packing.WordEncoder(packing.default_tokenizer(), remember=3)
    for text in ["Ab, aB. <|endoftext|> <|ENDOFTEXT|> x", "It's we'll THEY'RE", "H̱a Å Å", "\xa0a\x1cc\x85d", "12,3. a..b ?! İI ß",
                 "Été*** ÉTÉ!! Ñandú, ŉ ǰ", "日本 テスト.", "", "ΑΣ Σ. ﬁ"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_texts_encoded_together_look_up_a_piece_once(monkeypatch):
    """Each text was looked up by itself, and most hold an unknown piece, so most pieces were looked up twice."""
    asked = []

    class Counted(packing.Pieces):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    encoder = packing.WordEncoder(packing.default_tokenizer())
    encoder.known = Counted(encoder.tokenizer, {})
    texts = ["  the plum\t the\n", None, "", " \x0b ", "The plum, THE\x0cplum", "the é plum <|endoftext|>", "日本 the", "\x85a\x1cb\xa0c"]
    found = encoder.encode_all(pa.array([*texts, "cut off"]).slice(0, len(texts)))
    assert asked.count(b"the") == 1
    for text, ids in zip(texts, found.to_pylist()):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert encoder.encode_all(pa.array([], pa.string())).to_pylist() == []
    assert encoder.encode_all(pa.array([None, " "], pa.string())).to_pylist() == [b"", b""]
    # Texts are cut by bytes too; a text is never cut.
    monkeypatch.setattr(packing, "BATCH_BYTES", 10)
    rows = pa.RecordBatch.from_pydict({"doc_id": range(5), "queue": ["q"] * 5, "text": ["a" * 6, None, "b" * 6, "c" * 40, "d"]})
    cut = [b.column(0).to_pylist() for b in packing.text_batches([rows, rows.slice(0, 0)])]
    assert [x for b in cut for x in b] == list(range(5)) and cut == [[0, 1], [2], [3, 4]]


def test_substring(spark, empty, odd):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))
    passage = word(60)
    docs = spark.createDataFrame([(i, f"{word(40 + i)} {passage}\n{word(30)}") for i in range(4)], "doc_id long, text string")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r for r in substring.dedup(docs).collect()}
    assert after[0]["text"] == before[0]
    for i in range(1, 4):
        gone = len(before[i].split()) - len(after[i]["text"].split())
        assert 30 <= gone <= 62 and before[i].split()[:40] == after[i]["text"].split()[:40] and before[i].split()[-20:] == after[i]["text"].split()[-20:]
    assert substring.dedup(odd).count() == odd.count() and substring.without_repeats(empty).columns == empty.columns
    assert {r["text"] for r in substring.dedup(odd.where("doc_id = 1")).collect()} == {"A b c d"}


def test_chunks_resist_insertions():
    cuts = {x[3] for x in substring.chunks(LONG)}
    moved = {x[3] for x in substring.chunks(LONG[:5000] + " inserted words " + LONG[5000:])}
    assert len(cuts - moved) <= 4


def test_quality_follows_labels(spark, sf_dir, odd, empty):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.classify(documents(spark, sf_dir)).join(labels, "doc_id").select("kept", "quality").collect()
    good = [r["kept"] for r in found if r["quality"] == 1]
    assert np.mean(good) >= 0.97 and np.mean([r["kept"] == (r["quality"] == 1) for r in found]) >= 0.93
    rows = quality.classify(odd).collect()
    assert len(rows) == odd.count() and all(r["quality_score"] == 0 for r in rows if not (r["text"] or "").strip())
    assert quality.keep_good(empty).count() == 0


def test_estimated_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    patterns = {}
    for t in truth:
        p = "".join("g" if (rng.random() < (0.97 if t else 0.3)) else "b" for _ in quality.LABELLERS)
        patterns[p] = patterns.get(p, 0) + 1
    _, told = quality.estimate(patterns)
    assert all(abs(x["spares_good"] - 0.97) < 0.03 and abs(x["finds_bad"] - 0.7) < 0.08 for x in told.values())


def test_language_held_out(spark, sf_dir, odd, empty):
    rows = language.identify(documents(spark, sf_dir)).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.9
    named = {(r["doc_id"], r["text"]): r for r in language.identify(odd).collect()}
    assert named[2, None]["lang_pred"] == named[4, " \n "]["lang_pred"] == "und" and language.identify(empty).count() == 0


def test_phrases_against_plain_parse():
    text = "the cat sat on the mat and the dog sat on the log"
    model = language.Model({"en": text})
    for probe in ("the dog on the mat", "zzz the", "a", "tac eht", "the cat sat on the mat and the dog"):
        symbols = model.lookup[language.letters_of(probe)].tolist()
        source = model.lookup[language.letters_of(text)].tolist()
        inside = lambda p: any(source[i:i + len(p)] == p for i in range(len(source)))
        count, at = 0, 0
        while at < len(symbols):
            n = 1
            while at + n < len(symbols) and inside(symbols[at:at + n + 1]):
                n += 1
            count, at = count + 1, at + n
        grid = np.array([symbols], np.int64)
        assert model.automata[0].phrases(grid, np.array([len(symbols)])).tolist() == [count]


def test_toxicity_held_out(spark, odd, empty):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.classify(documents(spark, d), labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) >= 0.9
    nothing = labels.limit(0)
    assert toxicity.classify(odd, nothing).count() == odd.count() and toxicity.classify(empty, labels).count() == 0


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok <\\|x <\\\\| |"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "assistant", None), (2, 0, None, "é\n"), (2, None, "user", ""), (None, 1, "assistant", LONG),
            (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert found[conv]["turns_sha256"] == digest and found[conv]["n_turns"] == len(turns)
        assert found[conv]["loss_chars"] == len(loss) and found[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for r in chat.format_turns(df).collect():
        assert r["formatted"].count("<|") == 3
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_extraction_of_given_pages(spark, sf_dir):
    for r in extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        lines = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]+>", " ", re.sub(r"</?(p|h1)>", "\n", inner)).split("\n"))
        assert r["text"] == "\n".join(x for x in lines if x)


def test_extraction_of_other_pages(spark):
    page = ("<html><body><div class='top-menu'><a href=/>Home</a></div><div id=sidebar><p>side</p></div><div class='cookie-notice'>We use cookies</div>"
            "<div class='post-7 content'><h1>Title &eacute;</h1><p>One\n two&nbsp;<a href=x>link</a> three.<br>four<p>Second <b>bold</b> &lt;tag&gt;.</p>"
            "<ul><li>first item</li><li>second item</li></ul><form><input><button>Send</button></form><script>var p='<p>no</p>'</script>"
            "<div class=comments><p>A reader says a lot of things here, many more than the article.</p></div></div><footer>end</footer></body></html>")
    rows = [(1, "http://h.example/1", page), (1, "http://h.example/1", page), (2, None, None), (3, "::", ""), (4, "http://h.example/2", "<p>only"), (5, "http://x", "<" * 2000)]
    found = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1] == "Title é\nOne two link three. four\nSecond bold <tag>.\nfirst item\nsecond item"
    assert found[2] == found[3] == "" and found[4] == "only"


def test_neighbours_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    extra = [(10_001, None), (10_002, [0.0] * 64), (10_003, [float("nan")] * 64), (10_004, [None] * 64), (None, [1.0] * 64), (10_005, [1.0])]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + extra + [(int(ids[0]), x[0].tolist())], "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.search(df, leaf_rows=64).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]].tolist()
        hits += [v in best for v, _ in found[int(ids[i])]]
        assert all(abs(s - score[ids == v][0]) < 1e-9 for v, s in found[int(ids[i])])
    assert len(hits) == 20 * (ids % 20 == 0).sum() and np.mean(hits) >= 0.9
    assert neighbours.search(df.limit(0)).count() == 0


def test_neighbours_of_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)] + [(100, [2.0, 4.0])], "vec_id long, embedding array<double>")
    rows = neighbours.search(df).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in rows] == [100, *range(1, 20)] and rows[0]["score"] == 10.0


@pytest.mark.parametrize("n", [2, 3, 4])
@pytest.mark.parametrize("shape", ["<div class=content>{h}{s}</div>", "<div class=wrap>{h}<div class=body>{s}</div></div>",
                                   "<article>{h}<div class=body>{s}</div></article>", "{h}<article><div class=body>{s}</div></article>",
                                   "<div class=w><div class=w2>{h}<div class=a>{s}</div></div></div>"])
def test_extraction_of_split_articles(n, shape):
    parts = [f"part {i} " + "word " * 200 for i in range(n)]
    for tags in ("<section>{}</section>", "<div class=in><div><p>{}</p></div></div>"):
        page = "<html><body><nav>menu</nav>" + shape.format(h="<h1>Headline</h1>", s="".join(tags.format(p) for p in parts)) + "<footer>end</footer></body></html>"
        whole = "\n".join(["Headline", *(p.strip() for p in parts)])
        paths = [p for p, _ in sorted(extraction.votes(page), key=lambda v: -v[1])]
        assert extraction.main_text(page, paths) == whole and extraction.main_text(page, []) == whole
        one = page.replace("".join(tags.format(p) for p in parts[1:]), "")  # paths won by pages of one part
        assert extraction.main_text(page, [p for p, _ in sorted(extraction.votes(one), key=lambda v: -v[1])]) == whole


@pytest.mark.parametrize("head", ["<head><title>T</title><meta charset=utf-8><script>var a</script><body>", "<head><title>T</title>",
                                  "<head><title>T</title></head><body>", "<head><style>p {}</style><noscript><link href=x></noscript><body>"])
def test_extraction_with_open_head(head):
    page = f"<html>{head}<p>First <b>text</b>.</p><p>Second.</p></body></html>"
    assert extraction.main_text(page, []) == "First text.\nSecond."
    assert extraction.main_text("<head><title>T</title><b>Bold</b> start.<p>Then.", []) == "Bold start.\nThen."
    assert extraction.main_text("<head><title>T</title>Plain start.", []) == "Plain start."


def test_extraction_keeps_link_lists_of_the_article():
    items = [f"Linked name {i}" for i in range(6)]
    links = "<ul>" + "".join(f"<li><a href=x>{x}</a></li>" for x in items) + "</ul>"
    text = "<h1>Headline</h1><p>" + "word " * 60 + "</p>"
    whole = "\n".join(["Headline", ("word " * 60).strip(), *items])
    for page in (f"<article>{text}{links}</article>", f"<body><div class=content>{text}{links}</div>", f"<body>{text}{links}",
                 f"<body><ul class=menu>{links[4:]}<div class=content>{text}{links}</div>", f"<body><div><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About</a></ul></div><div class=content>{text}{links}</div>",
                 f"<body><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About</a></ul>{text}{links}",
                 f"<main>{text}<div class=refs>{links}</div></main>"):
        assert extraction.main_text(page, []) == whole


def test_toxicity_of_large_vocabulary(spark):
    pick = np.random.default_rng(3)
    words = ["".join(pick.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(5000)]
    bad, good = words[:3000], words[3000:]
    rows = []
    for i in range(4000):
        clean = pick.choice(good, 30).tolist()
        rows.append((i, " ".join(clean[:15] + (pick.choice(bad, 6).tolist() if i % 4 == 0 else []) + clean[15:]), int(i % 4 == 0)))
    rows.append((-1, " ".join(pick.choice(good, 16_000)), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    found = toxicity.classify(docs.drop("toxic"), docs.where("doc_id >= 0").drop("text")).join(docs.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in found if r["held_out"] and r["doc_id"] >= 0]
    assert np.mean([r["predicted"] for r in held if r["toxic"]]) >= 0.95 and np.mean([r["predicted"] for r in held if not r["toxic"]]) <= 0.05
    assert next(r for r in found if r["doc_id"] == -1)["predicted"] == 0


def test_toxicity_marks_and_ratios():
    marks = toxicity.present("Some text of words " * 3 + LONG[:5000])
    assert (toxicity.unpacked(toxicity.packed(marks)) == marks).all() and len(toxicity.unpacked(toxicity.packed(toxicity.present("")))) == 0
    wide = np.array([0, 65534, 65535, 131070, 262140, (1 << 22) - 1])
    assert toxicity.unpacked(toxicity.packed(wide)).tolist() == wide.tolist()
    ratio = toxicity.log_count_ratios(np.array([0, 1, 0, 5]), np.array([0, 0, 1, 5]), 10, 90)
    assert ratio[0] == 0 and ratio[1] > 0 > ratio[2] and ratio[3] > 0
