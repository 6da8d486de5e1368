"""Language model, archives, licences, secrets, token files, tokenizers and languages, against brute force and the public libraries."""

import base64
import bisect
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seatmetrics.llm import bpe, langid, licence_texts, licenses, lm, pretokens, secrets, token_files, warc
from seatmetrics.llm.licence_texts import TEMPLATES
from tests.llm.conftest import EDGES

RANKS = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))


# ---- language model ----


def lm_brute(rows, corpus, alpha=0.4, order=3, leave_out=True):
    split = lambda t: [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
    count = lambda docs: Counter(tuple(w[i : i + n]) for w in docs for n in range(1, order + 1) for i in range(len(w) - n + 1))
    whole, total = count(map(split, corpus)), sum(len(split(t)) for t in corpus)
    out = []
    for i, t in rows:
        w = split(t)
        own = count([w]) if leave_out else Counter()
        n_words = max(total - (len(w) if leave_out else 0), 1)
        score = 0.0
        for at in range(len(w)):
            top = min(at + 1, order)
            for n in range(top, 0, -1):
                g = tuple(w[at - n + 1 : at + 1])
                c = whole[g] - own[g]
                if c > 0 or n == 1:
                    below = n_words if n == 1 else whole[g[:-1]] - own[g[:-1]]
                    score += (top - n) * math.log(alpha) + math.log(max(c, 1) / below)
                    break
        out.append((i, len(w), round(score, 6), round(score / len(w), 8) if w else None))
    return sorted(out, key=str)


def lm_rows(df):
    return sorted(((r["doc_id"], r["n_words"], round(r["log_score"], 6), None if r["mean_log_score"] is None else round(r["mean_log_score"], 8)) for r in df.collect()), key=str)


def test_lm_scores(make_docs, words):
    rows = [(k, " ".join(words(20 + 9 * k, k % 7))[: 40 * k] + " The END") for k in range(40)] + [(99, "unseen words only")]
    docs = make_docs(rows)
    want = lm_brute(rows, [t for _, t in rows])
    assert lm_rows(lm.score_documents(docs)) == want
    assert lm_rows(lm.score_documents(docs, settings=lm.Settings(batch_words=50))) == want
    assert lm_rows(lm.score_documents(docs, settings=lm.Settings(batch_words=50, slot_words=40))) == want
    other = [(k, " ".join(words(30, 3 + k))) for k in range(9)]
    assert lm_rows(lm.score_documents(docs, make_docs(other))) == lm_brute(rows, [t for _, t in other], leave_out=False)


def test_slots_follow_the_input():
    bits = [lm.Settings().slot_bits(words) for words in (0, 10**7, 10**9, 10**10)]
    assert bits == sorted(bits) and 10**10 / 2 ** bits[-1] <= lm.Settings().slot_words


def test_lm_edges(make_docs):
    rows = [e for e in EDGES if e[0] not in (5, 9)]
    assert lm_rows(lm.score_documents(make_docs(rows))) == lm_brute(rows, [t for _, t in rows])
    assert lm.score_documents(make_docs([(1, "a")]).limit(0)).count() == 0
    assert lm_rows(lm.score_documents(make_docs([(1, None)]))) == [(1, 0, 0.0, None)]


@given(st.lists(st.integers(0, 2**63), max_size=40))
def test_packing_round_trip(values):
    v = np.array(sorted(set(values)), np.uint64)
    assert (lm.unpack(lm.pack(v)) == v).all()
    if len(v):
        assert (lm.unpack_sorted(lm.pack_sorted(v)) == v).all()


# ---- archives ----


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")


def test_archive_round_trip(spark):
    rows = [(k, f"http://h/{k % 5}\r\n", f"<p>{k % 9}</p>" + "é" * (k % 3), "z") for k in range(200)] + [(500, None, None, None), (501, "u", "", None), (None, "u", "<p>1</p>", None), (7, "again", "<p>7</p>é", None), (900, "long", "ab" * 2_000_000, None)]
    root, manifest = warc.archive(pages(spark, rows))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolved(warc.read_archive(spark, root, manifest)).collect()), key=str)
    body = [(i, (h or "").encode()) for i, _, h, _ in rows]
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    last = {}
    for i, b in body:
        if i is not None:
            last[b] = max(last.get(b, i), i)
    want = sorted(((i, len(b), digest(b), "response" if i == last.get(b) else "revisit", None if i == last.get(b) else last.get(b)) for i, b in body), key=str)
    assert got == want
    kept = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archive(spark, root, manifest).where("record_type = 'response'").collect()}
    assert all(kept[i] == b for i, b in body if i is not None and last[b] == i)
    root, manifest = warc.archive(pages(spark, []))
    assert warc.read_archive(spark, root, manifest).count() == 0


def test_damage_is_noticed(spark, tmp_path):
    """A payload that is not what its head says, and a revisit whose response is gone, stop the reader."""
    rows = [(k, "u", "<p>same</p>" if k < 2 else f"<p>{k}</p>", None) for k in range(5)]
    planned = warc.plan_records(pages(spark, rows))
    changed = planned.withColumn("payload", F.when(F.col("page_id") == 3, F.encode(F.lit("GARBAGE"), "UTF-8")).otherwise(F.col("payload")))
    root = f"file://{tmp_path}/changed"
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, root, warc.write_archive(changed, root), with_payload=False).collect()
    root = f"file://{tmp_path}/gone"
    manifest = warc.write_archive(planned.where("page_id <> 1"), root)
    with pytest.raises(Exception, match="no response with the payload of revisit 0"):
        warc.resolved(warc.read_archive(spark, root, manifest)).collect()


def test_archive_starts_with_its_dictionary(spark, tmp_path):
    root = f"file://{tmp_path}"
    _, manifest = warc.archive(pages(spark, [(k, "u", f"<html>{k}" + "body " * 40, None) for k in range(300)]), root)
    for r in manifest.collect():
        magic, size = struct.unpack("<II", (tmp_path / r["file"]).read_bytes()[:8])
        assert magic == warc.SKIPPABLE and size > 0


# ---- licences ----


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def consecutive(w, phrase):
    return [k for k in range(len(w)) if w[k : k + len(phrase)] == phrase]


def licence_brute(rows):
    """Every column by loops over all templates and all places, with document frequencies counted anew."""
    split = [plain_words(t) for _, t in rows]
    idf = {w: math.log((1 + len(rows)) / (1 + sum(w in d for d in map(set, split)))) + 1 for w in licenses.licence_words()}
    out = []
    for (i, _), w in zip(rows, split):
        places = sorted(k for p, _ in licenses.BASE_PHRASES for k in consecutive(w, p.split()))
        base = {lab for p, lab in licenses.BASE_PHRASES if consecutive(w, p.split())}
        labels, score = set(base), licenses.PHRASE_SCORE if base else 0.0
        at_word = {}
        for q, x in enumerate(w):
            at_word.setdefault(x, []).append(q)

        def near(x, q, wide, at_word=at_word):
            """Whether word x stands within ``wide`` of place q."""
            own = at_word.get(x, ())
            k = bisect.bisect_left(own, q - wide)
            return k < len(own) and own[k] <= q + wide

        for t in TEMPLATES:
            of, key = plain_words(t.text), plain_words(t.key)
            wide = max(2, len(of) // 12)
            rare = sorted(set(of), key=lambda x: (-idf[x], x))[: licenses.ANCHORS]
            anchors = [(k, x) for k, x in enumerate(of) if x in rare]
            keys = consecutive(w, key)
            for at in range(-len(of) - wide, len(w) + wide) if keys else ():
                if 100 * sum(near(x, at + k, wide) for k, x in anchors) < licenses.MEET * len(anchors):
                    continue
                share = sum(near(x, at + k, wide) for k, x in enumerate(of)) / len(of)
                if share >= licenses.AGREE - 1e-9 and any(at - wide <= p <= at + len(of) - len(key) + wide for p in keys):
                    labels.add(t.label)
                    score = max(score, share)
        out.append((str(i), len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=str)


def test_few_words_are_no_licence_and_changed_ones_are(make_docs):
    """A few words of a text in their places give no label; a word put in, left out or changed anywhere takes none away."""
    rng, rows, want = random.Random(4), [], {}
    for name, text in (("mit", licence_texts.MIT), ("bsd", licence_texts.BSD_3), ("boost", licence_texts.BOOST), ("isc", licence_texts.ISC), ("zlib", licence_texts.ZLIB)):
        of = plain_words(text)
        key = next(plain_words(t.key) for t in TEMPLATES if t.text == text)
        start = consecutive(of, key)[0]
        few = set(range(start, start + len(key))) | set(rng.sample(range(len(of)), 11))
        rows.append((len(rows), " ".join(x if k in few else "zzz" for k, x in enumerate(of))))
        want[len(rows) - 1] = ""
        for _ in range(25):
            at, other = rng.randrange(len(of)), of.copy()
            if start <= at < start + len(key):
                continue  # the key phrase is mandatory
            rng.choice((lambda: other.insert(at, "extra"), lambda: other.pop(at), lambda: other.__setitem__(at, "else")))()
            rows.append((len(rows), "# " + " ".join(other)))
            want[len(rows) - 1] = name
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert {i: x for i, (x, _) in got.items()} == want
    assert all(score > 0.95 for label, score in got.values() if label) and all(score == 0 for label, score in got.values() if not label)


def test_licences_equal_brute_force(make_docs, words):
    rng, rows = random.Random(12), [(1, "This is under the MIT License, see MIT-license."), (4, "an apache and a license"), (5, "GNU General Public License v3; Apache License"), (6, "nothing of the kind " * 50)]
    for k, t in enumerate(TEMPLATES):
        of = plain_words(t.text)
        changed = [x if rng.random() > rng.choice((0, 0.1, 0.4)) else "other" for x in of]
        cut = of[rng.randrange(len(of) // 2) :]
        rows += [(100 + k, " ".join(words(5, k) + of + words(9, k))), (200 + k, "// " + "\n// ".join(changed).upper()), (300 + k, " ".join(cut))]
    rows += [(7, licence_texts.MIT + licence_texts.ZLIB), (8, "software " * 3000 + licence_texts.ISC), (8, "software the"), (None, licence_texts.BSD_3)]
    rows += [(i + 1000 if i else i, t) for i, t in EDGES if i not in (5, 9)]
    got = licenses.scan_licenses(make_docs(rows)).collect()
    assert sorted(((str(r[0]), *tuple(r)[1:-1], round(r["score"], 9)) for r in got), key=str) == licence_brute(rows)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[7] == "mit,zlib" and labels[8] in ("isc", "") and labels[4] == ""
    assert all(t.label in labels[100 + k].split(",") for k, t in enumerate(TEMPLATES))
    long = [(i, t) for i, t in EDGES if i in (5, 9)]
    assert sorted((r["doc_id"], r["n_words"], r["labels"]) for r in licenses.scan_licenses(make_docs(long)).collect()) == [(5, 210_000, ""), (9, 1, "")]
    assert licenses.scan_licenses(make_docs([(1, "a")]).limit(0)).count() == 0


# ---- secrets ----


def secret_brute(text):
    found = []
    for no, (kind, pattern, least) in enumerate((("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32))):
        for m in re.finditer(pattern, text):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), no, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def secret_rows(df):
    base = [r.kind for r in secrets.BASE_RULES]
    return df.select("doc_id", secrets.span_text(F.filter("findings", lambda x: x["kind"].isin(base))).alias("base"), secrets.span_text(F.col("findings")).alias("all"))


SECRETS = [(1, "😀 Password = 'hunter2hunter2' token:short api_key=\"ABCDEFGHIJ\""), (2, "AKIA" + "B" * 16 + " AKIAX " + "0f" * 20 + "z" + "ab" * 9), (3, "passwdpassword=aaaaaaaaSECRET: bbbbbbbb"), (4, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20), (5, "pass\nword=12345678 tokentoken==abcdefgh"), (6, "token=" + "x" * 50_000 + " é secret=日本12345678")]


def test_secrets_equal_brute_force(make_docs):
    rows = SECRETS + [(i + 100 if i else i, t) for i, t in EDGES]
    got = sorted((str(r["doc_id"]), r["base"]) for r in secret_rows(secrets.scan_secrets(make_docs(rows))).collect())
    assert got == sorted((str(i), secret_brute(t or "")) for i, t in rows)
    more = {r["doc_id"]: r["all"] for r in secret_rows(secrets.scan_secrets(make_docs(SECRETS))).collect()}
    assert "private_key:0:31" in more[4] and "github:" in more[4]
    assert secrets.scan_secrets(make_docs(SECRETS).limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark, make_docs):
    ledger = secrets.BlobLedger(spark)
    base = secrets.BASE_RULES
    first = secret_rows(secrets.scan_secrets(make_docs(SECRETS[:3]), ledger=ledger, rules=base)).collect()
    n = ledger.scanned().count()
    again = secret_rows(secrets.scan_secrets(make_docs([*SECRETS[:3], (9, SECRETS[0][1])]), ledger=ledger, rules=base))
    assert ledger.scanned().count() == n and again.count() == 4 and len(first) == 3
    secrets.scan_secrets(make_docs(SECRETS[:4]), ledger=ledger, rules=secrets.RULES)
    assert ledger.scanned().count() == n + 4 and ledger.scanned().where(~F.array_contains("rules", "assign@1")).count() == 3


def test_findings_are_those_of_the_rule_versions_asked_for(spark, make_docs):
    """A stricter version withdraws spans, an older one brings them back without a scan, and the order of rules is free."""
    docs = make_docs([(1, "0f" * 20 + " AKIA" + "B" * 16), (2, "0f" * 20 + " AKIA" + "B" * 16), (3, "ab" * 40)])
    hex1, access = secrets.BASE_RULES[2], secrets.BASE_RULES[1]
    hex2 = secrets.Rule("hex", r"[0-9a-f]{64,}", least=64, version=2)
    ledger = secrets.BlobLedger(spark)

    def spans(rules):
        return {r["doc_id"]: r["all"] for r in secret_rows(secrets.scan_secrets(docs, ledger=ledger, rules=rules)).collect()}

    both = {1: "hex:0:40,access:41:61", 2: "hex:0:40,access:41:61", 3: "hex:0:80"}
    assert spans((hex1, access)) == both and spans((access, hex1)) == both
    assert spans((access, hex2)) == {1: "access:41:61", 2: "access:41:61", 3: "hex:0:80"}
    pairs = ledger.scanned().count()
    assert spans((hex1,)) == {1: "hex:0:40", 2: "hex:0:40", 3: "hex:0:80"} and ledger.scanned().count() == pairs
    assert {r["s"] for r in ledger.scanned().groupBy("blob_id").agg(F.size(F.flatten(F.collect_list("rules"))).alias("s")).collect()} == {3}


def test_findings_written_twice_count_once(spark, make_docs):
    """A run that broke off before it marked its pairs is repeated; many matches in one text; few and many shared blobs."""
    ledger = secrets.BlobLedger(spark)
    rows = [*SECRETS, (7, SECRETS[0][1]), (8, "token=abcdefgh " * 5_000)]
    docs = make_docs(rows)
    content = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob_id"), "text").where("text IS NOT NULL")
    secrets.matches(content.withColumn("_secret_todo", F.array(F.lit("access@1"), F.lit("hex@1"))), secrets.RULES).write.parquet(f"{ledger.root}/findings")
    want = sorted((str(i), secret_brute(t)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["base"]) for r in secret_rows(secrets.scan_secrets(docs, ledger=ledger)).collect()) == want


def test_many_shared_blobs_and_findings(make_docs, monkeypatch):
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", 0)
    rows = [*SECRETS, (7, SECRETS[0][1]), (8, None)]
    assert sorted((str(r["doc_id"]), r["base"]) for r in secret_rows(secrets.scan_secrets(make_docs(rows))).collect()) == sorted((str(i), secret_brute(t or "")) for i, t in rows)


def test_redaction(make_docs):
    found = secrets.scan_secrets(make_docs(SECRETS))
    got = {r["doc_id"]: r["t"] for r in found.select("doc_id", secrets.redacted(F.col("text"), F.col("findings")).alias("t")).collect()}
    assert got[1] == "😀 [SECRET]' token:short [SECRET]\"" and got[2].startswith("[SECRET] AKIAX [SECRET]z")


# ---- tokenizers and token files ----


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))


def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


ODD = ["don't can't I'LL we're'll ''s", "  a  b\n\n c ", "a b　c  ", "tab\tx \n", "'s've 'd", "1234abc ¼²", "͸ ퟿", "<|endoftext|> x", "a" * 3000, "🙂🙂 👨‍👩‍👧"]


def test_pretokens_equal_the_pattern():
    import regex

    for text in [*ODD, *(t or "" for _, t in EDGES)]:
        data, starts, ends, counts = pretokens.pieces([text])
        assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == regex.findall(public_tokenizers.PATTERN, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'sSdvt 1²\n\t é日.😀", max_size=40))
def test_both_encoders_equal_their_libraries(text):
    assert list(next(bpe.codec(public_tokenizers.path(bpe.VOCABULARY)).encode([text]))) == encoding().encode_ordinary(text)
    assert list(next(token_files.encoder(public_tokenizers.path(token_files.VOCABULARY)).encode_texts([text]))) == tokenizer().encode(text, add_special_tokens=False).ids


def test_added_tokens_as_the_library_has_them():
    path = public_tokenizers.path(token_files.VOCABULARY)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>", "<|endoftext", "", " <|endoftext|>  y\n"]
    own, library = token_files.encoder(path), tokenizer()
    assert [list(x) for x in own.encode_texts(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    library.encode_special_tokens = True
    assert [list(x) for x in token_files.encoder(path, True).encode_texts(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pretokens_that_share_a_hash(monkeypatch):
    """With a hash of eight values most pretokens collide, and still all ids are right."""
    plain = pretokens.hash_spans
    monkeypatch.setattr(pretokens, "hash_spans", lambda *a: plain(*a) & np.uint64(7))
    cache = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY)).cache
    for _ in range(2):
        assert [list(x) for x in cache.encode_texts([*ODD, "plain words stand here", ""])] == [encoding().encode_ordinary(t) for t in [*ODD, "plain words stand here", ""]]


def test_segment_tree_on_one_long_piece():
    rng = random.Random(2)
    piece = "".join(rng.choice("abcdeé") for _ in range(20_000))
    assert bpe.encode_piece(piece.encode(), RANKS) == encoding().encode_ordinary(piece)
    assert bpe.encode_piece(b"", RANKS) == []


def test_bpe_round_trip(make_docs):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(i + 100 if i else i, t) for i, t in EDGES]
    got = sorted(tuple(map(str, r)) for r in bpe.round_trip(make_docs(rows)).collect())
    enc, want = encoding(), []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((str(i), str(len(ids)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    ids = bpe.encode_documents(make_docs(rows).withColumn("token_ids", F.lit("old")))
    assert {r["doc_id"]: r["token_ids"] for r in ids.collect() if r["doc_id"] == 0} == {0: enc.encode_ordinary(ODD[0])}
    assert bpe.round_trip(make_docs(rows).limit(0)).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_variable_length_coding(values):
    v = np.array(values, np.uint32)
    control, data = token_files.pack(v)
    assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(v)) == v).all()


def test_token_files(spark, make_docs):
    rows = [(50 - k, t) for k, t in enumerate(ODD)] + [(i + 100, t) for i, t in EDGES if i]
    root, manifest = token_files.tokenize_to_files(make_docs(rows))
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_documents(spark, root, manifest).orderBy("start").collect()]
    enc, at, want = tokenizer(), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    root, manifest = token_files.tokenize_to_files(make_docs([(None, "a"), (1, None)]))
    assert {(r["doc_id"], r["n_tokens"]) for r in token_files.read_documents(spark, root, manifest).collect()} == {(None, 2), (1, 1)}
    root, manifest = token_files.tokenize_to_files(make_docs([(None, f"a{k}") for k in range(400)] + [(1, None)]))
    back = token_files.read_documents(spark, root, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None] * 400 + [1]
    root, manifest = token_files.tokenize_to_files(make_docs(rows).limit(0))
    assert token_files.read_documents(spark, root, manifest).count() == 0


# ---- languages ----


def test_codewords_differ():
    for k in (2, 3, 5, 7, 12):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code}) == k
        assert all(len(set(c)) == 2 for c in code.T)


def test_language_id(spark, make_docs):
    rng = random.Random(6)
    sounds = {"aa": "ka to mi ne ra".split(), "bb": "schl ung ber ach ein".split(), "cc": "qu eau ment ion les".split(), "dd": "ll ción os ue da".split(), "ee": "zsz ów prz nie ko".split()}
    rows = [(k, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang) for k in range(600) for lang in [list(sounds)[k % 5]]]
    docs = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "123 ! ² ½ _", "bb"), (1002, "", None), (None, "kato", None)], "doc_id bigint, text string, lang string").withColumn("lang_pred", F.lit("old"))
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).withColumn("held_out", langid.held_out()).collect()}
    tested = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert len(tested) > 100 and sum(a == b for a, b in tested) >= 0.97 * len(tested)
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 for i in (1000, 1001, 1002))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    nothing = langid.fit(docs.where("false").select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_sample_is_bounded_whatever_the_rows(spark):
    """Many rows of one id, of one text, and many labels: the sample keeps its limits and prefers labels with many texts."""
    rows = [(1, f"text number {k}", "aa") for k in range(3000)] + [(k, "the same text", "bb") for k in range(2000)] + [(k, f"rare {k}", f"l{k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.bounded_sample(docs, 50, 10, 1000).groupBy("lang").count().collect()
    n = {r["lang"]: r["count"] for r in got}
    assert len(n) == 10 and n["aa"] == 50 and all(v <= 50 for v in n.values())
    assert langid.bounded_sample(docs, 50, 4, 40).count() == 13 and langid.bounded_sample(docs.limit(0), 5, 5, 5).count() == 0


def test_long_and_repeated_texts_have_one_language(spark):
    rows = [(k, "ka to mi " * (k + 1), "aa") for k in range(20)] + [(100 + k, "schr ung " * (k + 1), "bb") for k in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    docs = spark.createDataFrame([(1, "ka to mi " * 200_000), (2, "mi to ka"), (2, "mi to ka"), (3, "ung schr")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, model).collect())
    assert got == [(1, "aa"), (2, "aa"), (2, "aa"), (3, "bb")]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_held_out_accuracy_on_the_tables(spark, sf):
    from seatmetrics.llm import queries

    got = queries.op9_language_id(spark, f"/root/testdata/{sf}").where("held_out").join(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).collect()[0]
    assert n > 20 and right >= 0.97
