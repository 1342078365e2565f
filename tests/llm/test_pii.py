"""Personal data against the plain patterns and checks."""

import hashlib
import random
import re

from cairnline.llm import pii, queries

#: The plain patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + n % 2), 10)) for n, d in enumerate(reversed(digits))) % 10 == 0


def iban(code):
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
        "iban": lambda: iban(m.replace(" ", "")),
        "ssn": lambda: not re.search("^(?:000|666|9)|-00-|-0000$", m),
        "tel": lambda: 9 <= len(digits) <= 12,
        "mail": lambda: True,
    }[kind]()


def plain(text):
    text = text or ""
    base, more = [], []
    for n, kind in enumerate(pii.KINDS):
        if kind.base:
            base += [(m.start(), n, m.end(), kind.name) for m in re.finditer(PLAIN[kind.name], text) if valid(kind.name, m.group())]
            continue
        # Python's lookbehind wants one length
        pattern = kind.pattern.replace(r"(?<!\+[0-9]{1,3} )", r"(?<!\+[0-9] )(?<!\+[0-9]{2} )(?<!\+[0-9]{3} )")
        all_ = list(re.finditer(pattern, text))
        for k, m in enumerate(all_):
            low = all_[k - 1].end() if k else 0
            high = all_[k + 1].start() if k + 1 < len(all_) else len(text)
            near = text[max(low, m.start() - pii.NEAR) : m.start()] + " " + text[m.end() : min(high, m.end() + pii.NEAR)]
            has = lambda words: bool(re.search(rf"(?i)(?<![^\W\d_])(?:{words})(?![^\W\d_])", near))  # noqa: E731, B023
            score = kind.score + kind.by * has(kind.up) - (kind.by * has(kind.down) if kind.down else 0)
            if valid(kind.name, m.group()) and round(min(max(score, 0), 1), 3) >= pii.LEAST:
                more.append((m.start(), n, m.end(), kind.name))
    join = lambda spans: ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in sorted(spans))
    counts = [sum(s[3] == kind for s in base) for kind in PLAIN]
    return (*counts, hashlib.sha256(join(base).encode()).hexdigest(), join(base + more))


def compare(docs):
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, *tuple(r)[1:]) for r in pii.digests(docs).collect()))
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, *plain(r["text"])) for r in docs.select("doc_id", "text").collect()))
    for g, w in zip(got, want, strict=True):
        assert g == w
    return want


CASES = [
    "mail a.b@c.de, x@y x@y.z. a@b.c+d@e.f p@q@r.s @ a@b..c +@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 999999999999999999999.1.1.1", "card 4465758382889437 4465 7583 8288 9437, 4465-7583-8288-9438",
    "4465758382889437 4465758382889437", "call +1 (663) 555-6869 or +49-30-1234567. +1 +12 +1234567890123456", "é日本😀 x@y.zz 😀 10.0.0.1", "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 IS OK, DE89370400440532013001",
    "SSN 123-45-6789, not 123-45-6780 here", "no word in reach of this number, whatever one thinks of it: 123-45-6789", "phone (030) 123 4567 fax 0301 123 4567 +49 301 123 4567", "Tel. 555-123-4567; téléphone 012 345 6789", "write to jo [at] example [dot] org or jo(at)x(dot)y(dot)z",
    "tel\n012 345\n6789", "+1\t234567890", "", "0" * 16, "1 " * 40, "+" * 9 + "1()()()()2345678901", "\x00 4465758382889437 \x00",
]


def test_cases(make, odd, empty):
    want = compare(make(list(enumerate([*CASES, None, None, *CASES[:3]]))))
    assert "iban" in str(want) and "ssn" in str(want) and "tel" in str(want) and "mail:" in str(want)
    compare(odd)
    assert pii.digests(empty).count() == 0


def test_random_texts(make):
    rng = random.Random(5)
    parts = ["a", "b1", "@", ".", "-", " ", "+", "4465758382889437", "12", "255", "(", ")", "%", "\n", "é", "DE89370400440532013000", "tel", "7", " ", "😀", "[at]", "[dot]", "123-45-6789", "ssn "]
    compare(make([(n, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for n in range(600)]))


def long_texts(n):
    many = "x@y.zz é " * (n // 60) + "10.0.0.1 " * (n // 400)
    return ["x" * n, "1" * n, "1." * (n // 2), "a." * (n // 3) + "@", "a@" + "b." * (n // 3), "+1" + " " * n, many, "DE89 " * (n // 5), "1-" * (n // 3)]


def test_long_texts(make):
    """Long runs cost their length, and many matches are placed right."""
    compare(make(list(enumerate(long_texts(6_000)))))
    # the plain patterns would take hours here
    rows = {r["doc_id"]: r for r in pii.digests(make(list(enumerate(long_texts(300_000))))).collect()}
    assert [rows[n]["n_email"] for n in range(9)] == [0, 0, 0, 0, 1, 0, 5000, 0, 0]
    assert rows[6]["n_ip"] == 750 and rows[6]["spans"].endswith(f"ip:{45_000 + 749 * 9}:{45_000 + 749 * 9 + 8}") and rows[2]["n_ip"] == 37_500


def test_scores_follow_words_nearby(make):
    rows = pii.find(make([(1, "server at 10.0.0.1"), (2, "version 10.0.0.1"), (3, "it is 10.0.0.1")])).collect()
    score = {r["doc_id"]: r["pii"][0]["score"] for r in rows}
    assert score[1] > score[3] > score[2] and all(r["pii"][0]["base"] and r["pii"][0]["text"] == "10.0.0.1" for r in rows)
    assert rows[0]["lang"] == "en" and "component" in rows[0]


def test_whole_table(spark):
    place = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_pii"](spark, place).collect()}
    assert got == {i: plain(t) for i, t in texts.items()}
