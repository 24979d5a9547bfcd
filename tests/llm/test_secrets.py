import base64
import hashlib
import random
import re

from ledgerscope.llm import secrets as s
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def plain(text):
    text = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], s.KINDS.index(x[0])))


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_patterns_on_random_text():
    rng = random.Random(2)
    parts = ["password", "PASSWD", "Token", "api_key", "apikey", "secret", "=", ": ", '"', "'", " ", "é", "AKIA", "ABC123",
             "0123456789abcdef", "deadbeef", "zz", "x" * 12, "A" * 14, "\n", "tokeN", "ſecret"]
    for _ in range(3_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        raw = text.encode()
        got = s.base_spans(raw)
        at = s._points(raw, [(a, b) for _, a, b in got])
        got = sorted(((k, a, b) for (k, _, _), (a, b) in zip(got, at)), key=lambda x: (x[1], s.KINDS.index(x[0])))
        assert got == plain(text), text


def test_battery_tells_random_from_structured():
    rng = random.Random(4)
    for name, alphabet in s.ENCODINGS.items():
        low = sum(s.combined("".join(rng.choices(alphabet, k=40)), name) < 0.01 for _ in range(500))
        assert low <= 20, name
    for word in ["aaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789", "A1A1A1A1A1A1A1A1A1A1A1A1"]:
        assert s.combined(word, s.infer(word)) < 1e-4, word
    assert s.infer("thtionststhshtiinging") is None
    assert s.infer("THE-QUICK-BROWN-FOX-JUMPS") is None


def test_odd_rows_and_planted_secrets(spark):
    rng = random.Random(9)
    key = base64.b64encode(rng.randbytes(36)).decode()
    rows = [
        (1, f"see {key} here", "x"), (2, None, None), (3, "", "x"), (None, "AKIA" + "Z" * 16, "x"), (4, "plain prose " * 20_000, "x"),
        (5, "é password=abcdefghijkl é", "x"), (5, "é password=abcdefghijkl é", "x"), (6, "a1a1a1a1a1a1a1a1a1a1a1a1a1a1", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = s.report(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].spans == f"random:4:{4 + len(key.rstrip('='))}" and by[2].spans == "" == by[4].spans
    assert by[5].spans == "assign:2:23" and by[None].n_access == 1
    assert "random" not in by[6].spans
    assert s.report(docs.filter("false")).count() == 0
    assert s.find_secrets(docs).columns == ["row", "base", "spans"]


def test_query_against_plain_patterns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op10_secrets"][0](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in s.KINDS[:3])
        assert shown([x for x in want]) == ",".join(x for x in r.spans.split(",") if x and not x.startswith("random"))


def test_secrets_inside_names_urls_and_dotted_tokens(spark):
    rng = random.Random(12)
    letters = s.ENCODINGS["base62"]
    keys = ["".join(rng.choices(letters, k=40)) for _ in range(8)]
    low = "".join(rng.choices(s.ENCODINGS["base36"], k=40))
    texts = [
        f"auth={keys[0]}", f"AWS_KEY={keys[1]}", f"sig={keys[2]}&x", f"{keys[3]}.{keys[4]}.{keys[5]}", f"https://host-a.example.org/my_files/{keys[6]}",
        f"//host/path/{low}", f"é session={keys[7]}==",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in s.report(docs).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        text = texts[r.doc_id]
        found = [text[int(a) : int(b)] for kind, a, b in spans if kind == "random"]
        want = [k for k in (*keys, low) if k in text]
        assert len(found) == len(want) and all(f.endswith(k) for f, k in zip(found, want)), (text, r.spans)


LEXICON = (
    "get set user account by id handler test should return when missing load config from yaml file parse request response "
    "cache index value buffer stream open close read write update delete create list item price order customer name"
).split()


def identifier(rng):
    words = [rng.choice(LEXICON) for _ in range(rng.randint(4, 7))]
    digits = str(rng.randint(2, 9999))
    style = rng.randint(0, 4)
    if style == 0:
        words = [w.capitalize() for w in words]
        words.insert(rng.randint(1, len(words)), digits)
        return "".join(words)
    if style == 1:
        return "_".join(words) + "_" + digits
    if style == 2:
        return words[0] + "".join(w.capitalize() for w in words[1:]) + digits
    if style == 3:
        return "/".join(words) + "/" + words[0] + digits
    return "".join(words) + digits


def test_few_false_secrets_among_identifiers(spark):
    """Precision and recall with twenty identifiers to a key, after prose of the same language."""
    rng = random.Random(21)
    named = ["getUserAccountById2Handler", "testShouldReturn404WhenMissing", "LoadConfigV2FromYamlFile", "parse_http2_request_headers_v3"]
    names = sorted({identifier(rng) for _ in range(2_000)} | set(named))
    keys = {}
    for name in ("HEX", "base32", "base36", "BASE36", "base62", "base64"):
        for n in (20, 24, 32, 40, 64):
            for _ in range(4):
                token = "".join(rng.choices(s.ENCODINGS[name].replace("/", "").replace("+", ""), k=n))
                if s.infer(token):
                    keys[token] = n
    prose = [" ".join(rng.choices(LEXICON, k=400)) for _ in range(50)]
    texts = prose + [f"see {n} for more" for n in names] + [f"see {k} for more" for k in keys]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = set()
    for r in s.report(docs).collect():
        for x in filter(None, r.spans.split(",")):
            kind, a, b = x.split(":")
            if kind == "random":
                found.add(texts[r.doc_id][int(a) : int(b)])
    false = [f for f in found if f not in keys]
    assert len(false) <= 0.01 * max(1, len(found)), false[:5]
    assert len(found & set(keys)) >= 0.95 * len(keys)
    assert not any(n in found for n in named)


def test_e_values_bound_false_reports():
    """Tokens drawn from the model of structured tokens itself: reports stay within the bound."""
    counts = [("base62:9", 0, 0, 9_900), ("base62:9", 0, 30, 100)]
    assert s.reported_odds(counts, {"base62:9": 5}) == 30
    assert s.reported_odds([("base62:9", 0, 3, 10_000)], {"base62:9": 5}) == s.E_GRID + 1
    # What the battery takes for structured has no e-value.
    assert s.reported_odds(counts, {"base62:9": 0}) == s.E_GRID + 1


def test_pair_counts_stop_at_texts():
    import pyarrow as pa

    got = s.pair_counts(pa.array(["ab", None, "B a", "é", "aB"]))
    assert got[0, 1] == 2 and got[26, 0] == 3 and got[26, 1] == 1 and got.sum() == 6
