"""Operators on documents: against brute force, and on edge rows."""

import os
import zlib

import brute
import pytest

pytest.importorskip("settlerank.llm")
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(dice, n, lines=1):
    words = [dice.choice(VOCABULARY) for _ in range(n)]
    step = max(1, n // lines)
    return "\n".join(" ".join(words[i:i + step]) for i in range(0, n, step))


def changed(dice, text, times):
    words = text.split(" ")
    for _ in range(times):
        words[dice.randrange(len(words))] = dice.choice(VOCABULARY)
    return " ".join(words)


def as_rows(texts):
    return [(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]


def test_jaccard_groups_equal_brute_force(documents, dice):
    from settlerank.llm.setjoin import jaccard_groups
    texts = []
    for size in [3, 5, 6, 8, 9, 10, 12, 14, 16, 18, 20, 40, 80, 200]:
        base = prose(dice, size)
        texts += [base, base.upper(), base] + [changed(dice, base, k) for k in (1, 1, 2, 4)]
        texts += [base + " " + prose(dice, k) for k in (1, 2, max(1, size // 8))]
    shared = prose(dice, 60)
    texts += [prose(dice, 50) + " " + shared + " " + prose(dice, 50) for _ in range(30)]      # one passage in many texts
    base = prose(dice, 150)
    texts += [changed(dice, base, dice.randrange(6)) for _ in range(60)] + ["", None, "  "]    # one large group
    rows = as_rows(texts)
    dice.shuffle(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(documents(rows)).collect()}
    assert found == brute.jaccard_groups([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("n", range(1, 13))
def test_subsets_meet_where_sets_link(n):
    import numpy as np
    from settlerank.llm.arrays import mix
    from settlerank.llm.setjoin import least_overlap, linked, partner_sizes, subset_keys
    values = mix(np.arange(1, 40, dtype=np.uint64))
    a = np.sort(values[:n])
    for m in partner_sizes(n):
        for shared in range(min(n, m) + 1):
            b = np.sort(np.concatenate([values[:shared], values[20:20 + m - shared]]))
            assert linked(a, b) == (shared >= least_overlap(n, m))
            assert not linked(a, b) or set(subset_keys(a)) & set(subset_keys(b))


def test_bitmaps_prune_no_link(dice):
    import numpy as np
    from settlerank.llm.arrays import mix
    from settlerank.llm.setjoin import bitmap, linked, may_link
    for _ in range(300):
        n, extra, gone = dice.randrange(1, 300), dice.randrange(60), dice.randrange(60)
        pool = mix(np.array(dice.sample(range(10**9), n + extra), np.uint64))
        a, b = np.unique(pool[:n]), np.unique(pool[min(gone, n - 1):])
        assert not linked(a, b) or may_link(bitmap(a), bitmap(b), len(a) + len(b))


def test_masks_find_every_window_with_two_substitutions():
    import itertools
    from settlerank.llm.seeds import IGNORED, WINDOW
    ignored = [{(s + i) % WINDOW for i in IGNORED} for s in range(WINDOW)]
    assert all(any({a, b} <= mask for mask in ignored) for a, b in itertools.combinations(range(WINDOW), 2))


def test_contamination_equals_brute_force(spark, documents, dice):
    from settlerank.llm.seeds import decontaminate, find_contamination
    items = [prose(dice, n) for n in (4, 9, 12, 13, 15, 30, 60)] + ["", None]
    texts = []
    for item in items[:-2]:
        for times in (0, 1, 2, 3, 5):
            texts.append(prose(dice, 20) + " " + changed(dice, item, times) + " " + prose(dice, 20))
        texts += [prose(dice, 30) + "\n" + item.upper().replace(" ", ", "), " ".join(item.split()[:-1])]
    texts += [prose(dice, 100) for _ in range(20)] + ["", None]
    docs = documents(as_rows(texts))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = {(i, j) for i, t in enumerate(texts) for j, b in enumerate(items) if brute.contaminated(t, b)}
    found = {(r["doc_id"], r["item_id"]) for r in find_contamination(docs, bench).collect()}
    assert found == expected and len(expected) > 20
    kept = {r["doc_id"] for r in decontaminate(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in expected}


def test_line_dedup_equals_brute_force(documents, dice):
    from settlerank.llm.lines import deduplicate_lines
    lines = [prose(dice, n) for n in (1, 3, 10, 40, 60, 90, 130, 300)]
    lines += [changed(dice, dice.choice(lines[3:]), dice.choice([1, 1, 2])) for _ in range(40)] + ["---", "", "A  b, c!", "a b c"]
    base = prose(dice, 120)
    lines += [changed(dice, base, 1) for _ in range(40)]                # one large group
    texts = ["\n".join(dice.choice(lines) for _ in range(dice.randrange(1, 8))) for _ in range(80)] + [None, ""]
    found = {r["doc_id"]: r["text"] for r in deduplicate_lines(documents(as_rows(texts))).collect()}
    assert found == brute.deduplicated(list(enumerate(texts)))


def test_simhash_equals_brute_force(spark, dice, monkeypatch):
    from pyspark.sql import functions as F
    from settlerank.llm import lines
    texts = [prose(dice, n) for n in (1, 2, 7, 126, 255, 700)] + [" ".join(f"x{i}" for i in range(n)) for n in (300, 1000)]
    rows = spark.createDataFrame([(t,) for t in texts], "norm string").withColumn("words", F.split("norm", " "))
    for chunk in (lines._CHUNK, 250):
        monkeypatch.setattr(lines, "_CHUNK", chunk)
        found = lines.simhashes(rows, ["norm"]).collect()
        assert len(found) == len(texts) and all(r["sim"] % (1 << 64) == brute.simhash(r["norm"]) for r in found)


def test_distance_equals_brute_force(spark, dice):
    from pyspark.sql import functions as F
    from settlerank.llm.lines import with_distance
    pairs = [("", "a"), ("abc", "abc"), ("aaaa", "aa"), ("é日x", "é日日x"), ("abcabc", "abc"), ("xabc", "yabc")]
    for _ in range(60):
        a = "".join(dice.choice("ab é") for _ in range(dice.randrange(30)))
        b = list(a)
        for _ in range(dice.randrange(5)):
            b.insert(dice.randrange(len(b) + 1), dice.choice("abc"))
        pairs.append((a, "".join(b)))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, ta string, tb string")
    found = {r["i"]: r["distance"] for r in with_distance(rows, F.lit(100)).collect()}
    assert found == {i: brute.edit_distance(a, b) for i, (a, b) in enumerate(pairs)}


def _model():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library_and_come_back(documents, dice):
    import sentencepiece
    from settlerank.llm.pieces import decode_pieces, encode_pieces
    texts = [prose(dice, 50), "The  quick\n\nbrown fox ", " ", "", None, "aaaaaaaaaaaaa", "<s> <unk> <0x0A>", "é中文🎉\t\x00x",
             "Hello, world! " * 200, "supercalifragilistic" * 30]
    library = sentencepiece.SentencePieceProcessor(model_file=_model())
    coded = encode_pieces(documents(as_rows(texts)), _model())
    assert coded.columns[-1] == "ids" and len(coded.columns) == 6
    for r in coded.collect():
        assert r["ids"] == library.encode(r["text"] or "")
    for r in decode_pieces(coded, _model()).collect():
        assert r["text"] == (texts[r["doc_id"]] or "") and r["n_tokens"] == len(library.encode(r["text"]))


def test_unigram_pieces_are_the_best_path(dice):
    import itertools
    import numpy as np
    from sentencepiece import sentencepiece_model_pb2
    from settlerank.llm.pieces import MARK, PieceModel
    made = sentencepiece_model_pb2.ModelProto()
    made.pieces.add(piece="<unk>", score=0, type=2)
    for piece in ["a", "b", "c", "ab", "bc", "abc", "ca", MARK, MARK + "a", MARK + "ab", "bca"]:
        made.pieces.add(piece=piece, score=-dice.uniform(1, 6), type=1)
    made.trainer_spec.model_type, made.normalizer_spec.add_dummy_prefix = 1, True
    made.normalizer_spec.remove_extra_whitespaces, made.normalizer_spec.escape_whitespaces = False, True
    model = PieceModel(data=made.SerializeToString())
    texts = ["".join(p) for n in range(1, 6) for p in itertools.product("abc", repeat=n)][:300]

    def best(word):
        if not word:
            return 0.0
        return max(model.scores[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in model.scores)
    for text, ids in zip(texts, model.encode(texts)):
        assert np.isclose(sum(model.scores[model.pieces[i]] for i in ids), best(MARK + text))
        assert model.decode(ids) == text


def _tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def _ids(texts):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(_tokenizer())
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


ODD_TEXTS = ["It's THE end.", "a <|endoftext|> b <|ENDOFTEXT|>", "x\x1cy\x85z\xa0w", "Ünïcode ΣΑΣ İstanbul é", "a,b .. ., ,. x.,",
             "word " * 3000, "\x01 a \x01b", "", None, " \n "]


def test_token_counts_and_their_cache(spark, documents, tmp_path):
    from settlerank.llm.tokens import count_table, token_counts
    texts = ODD_TEXTS + ["  It's   THE\tend. ", "It's THE end."]
    docs, cache = documents(as_rows(texts)), str(tmp_path / "cache")
    expected = {(i, len((t or "").encode()), len(ids), len(ids) > 2048) for i, (t, ids) in enumerate(zip(texts, _ids(texts)))}
    assert {tuple(r) for r in token_counts(docs, _tokenizer(), cache).collect()} == expected
    stored = count_table(spark, cache).count()
    assert stored == len({b" ".join((t or "").encode().split()) for t in texts})
    assert {tuple(r) for r in token_counts(docs, _tokenizer(), cache).collect()} == expected
    assert count_table(spark, cache).count() == stored                  # nothing new to encode
    token_counts(documents(as_rows(["a new text"])), _tokenizer(), cache).collect()
    assert count_table(spark, cache).count() == stored + 1


def test_records_come_back(spark, documents, tmp_path):
    import numpy as np
    from settlerank.llm.records import read_manifest, read_one, read_records, unframe, write_records
    texts = ODD_TEXTS * 3
    folder = str(tmp_path / "records")
    write_records(documents(as_rows(texts)[::-1]), folder, _tokenizer(), shards=3)
    ids = [x + [2] for x in _ids(texts)]
    start, expected = 0, []
    for i, x in enumerate(ids):
        expected.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    found = sorted(tuple(r) for r in read_records(spark, folder).collect())
    assert [r[:4] for r in found] == expected
    width = read_manifest(spark, folder).first()["width"]
    for doc, *_, file, offset in found[::-2]:
        assert read_one(folder, file, offset, width)[1].tolist() == ids[doc]
    name = next(f for f in os.listdir(folder) if f.endswith(".rec") and os.path.getsize(f"{folder}/{f}") > 100)
    with open(f"{folder}/{name}", "r+b") as file:
        file.seek(14)
        byte = file.read(1)
        file.seek(14)
        file.write(bytes([byte[0] ^ 1]))
        file.flush()
        file.seek(0)
        with pytest.raises(ValueError):
            unframe(file)


def test_host_rules(documents, dice):
    from settlerank.llm.rules import quality_rules
    good, bad = prose(dice, 80), "short text"
    rows = [(i, good, "en", "good", 1) for i in range(20)] + [(20 + i, bad, "en", "bad", 1) for i in range(20)]
    rows += [(40, good, "en", "bad", 1), (41, good, "en", None, 1), (42, "a b c " * 40, "en", "good", 1), (43, None, "en", "good", 1)]
    found = {r["doc_id"]: r for r in quality_rules(documents(rows)).collect()}
    assert all(found[i]["kept"] for i in [*range(20), 41])
    assert not found[40]["kept"] and not found[40]["base_failed"] and found[40]["host_rate"] > 0.5
    assert found[42]["base_failed"] and found[42]["n_repeat_words"] == 120 and found[43]["n_words"] == 0


def test_text_counts_equal_brute_force():
    import pyarrow as pa
    from settlerank.llm.rules import text_counts
    texts = ["a b c a b c a", "x\nx\ny\n\n\nx", "é# $ü\n|<>", "", "one", "l1\nl1 \nl1", "a a a a a", "\n\n"]
    counts = text_counts(pa.array(texts))
    for i, t in enumerate(texts):
        words, lines = brute.words_of(t), [x for x in t.split("\n") if brute.words_of(x)]
        wins = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        covered = {k + d for k, w in enumerate(wins) if wins.count(w) > 1 for d in range(3)}
        assert [int(counts[c][i]) for c in counts] == [
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)]


def test_edge_rows(edge, nothing, spark, tmp_path):
    from settlerank.llm.lines import deduplicate_lines
    from settlerank.llm.pieces import encode_pieces
    from settlerank.llm.pii import pseudonymise
    from settlerank.llm.records import read_records, write_records
    from settlerank.llm.rules import quality_rules
    from settlerank.llm.seeds import decontaminate, find_contamination
    from settlerank.llm.setjoin import jaccard_groups
    from settlerank.llm.tokens import token_counts
    bench = spark.createDataFrame([(1, "line number 7 of a long text line number 8 of a long text"), (2, None), (None, "")],
                                  "item_id long, text string")
    for k, docs in enumerate((edge, nothing)):
        n = 11 if k == 0 else 0
        groups = [tuple(r) for r in jaccard_groups(docs).collect()]
        assert len(groups) == n and (not n or (1, 7, 1) in groups and (None, 1, None) in groups and (3, 0, 3) in groups)
        hits = [tuple(r)[:2] for r in find_contamination(docs, bench).collect()]
        assert hits == ([(6, 1)] if n else [])
        assert decontaminate(docs, bench).count() == max(0, n - 1)
        lines = deduplicate_lines(docs)
        assert lines.count() == n and lines.columns == [*docs.columns, "n_removed_lines"]
        assert encode_pieces(docs, _model()).count() == n
        assert pseudonymise(docs, "k").count() == n
        assert quality_rules(docs).count() == n
        assert token_counts(docs, _tokenizer(), str(tmp_path / f"cache{k}")).count() == n
        write_records(docs, str(tmp_path / f"records{k}"), _tokenizer())
        assert read_records(spark, str(tmp_path / f"records{k}")).count() == n


def test_empty_benchmark(edge, spark):
    from settlerank.llm.seeds import find_contamination
    assert find_contamination(edge, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_token_counts_of_many_rows_without_an_id(spark, documents):
    """Rows with null or shared ids are looked up one by one, not all with all."""
    import time
    from settlerank.llm.queries import tokenizer
    from settlerank.llm.tokens import new_cache, token_counts
    rows = [(None if i % 2 else 5, f"text number {i} of {i * 7}", "en", "s", 1) for i in range(20_000)]
    start = time.time()
    found = token_counts(documents(rows), tokenizer("word_bpe_49k.json"), new_cache(spark)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in found} == {None: 10_000, 5: 10_000} and time.time() - start < 60
