"""Problem 9: detection on made-up texts, and surrogates."""

from __future__ import annotations

import re

import pytest

from quarrylight.llm import personal

GIVEN = "Anselma Bertholt Corvina Dagrun Élodine Fionnula Gerwulf Hildrun".split()
FAMILY = "Quellmoor Starbrook Weißhügel Fontclair Montverde Ashwick Oberlind Pellham".split()
MODEL = personal.NameModel([f"{g} {f}" for g in GIVEN for f in FAMILY], "the call of scanner blast radius quiet harbor service locator grace period please review signed".split())


def kinds(text):
    out = {}
    for a, b, k in personal.find(text, MODEL):
        out.setdefault(k, []).append(text[a:b])
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mail a.b+c@x1.site.example. Or JOE AT site DOT example, joe(at)site.example; [at]", {"email": ["a.b+c@x1.site.example", "JOE AT site DOT example", "joe(at)site.example"]}),
        ("clone git@host.example:team/repo.git, user@host, @scope/pkg@4.14.1, @handle", {}),
        ("call (212) 555-0163 or +44 (0)20 7946 0372 ext. 12, 030/23125-679, 1 (212) 555 0130", {"phone": ["(212) 555-0163", "+44 (0)20 7946 0372", "030/23125-679", "1 (212) 555 0130"]}),
        ("Eastmere 40213\n1 (415) 555 0160\nbuild 415-220-1163 failed, Build 910-27-5355, version 636-106-630", {"phone": ["1 (415) 555 0160"]}),
        ("Trace id 04521209414, version 10.1985.248.8, on 2024-09-14, host 192.0.2.250, build 3032-116-2261, rows 5 550 1127", {}),
        ("SSN 910 27 5355; passport no. Q0FPF23LN; Steuer-ID 02 153 464 646; sécurité sociale 9 48 12 73 794 610 89; DNI 99856968F", {"id_number": ["910 27 5355", "Q0FPF23LN", "02 153 464 646", "9 48 12 73 794 610 89", "99856968F"]}),
        ("went to 153B West Orchard Avenue, flat 2. Lane 230 of the tracer Street fixture is new. An Querufer 209, 00415 Ort", {"address": ["153B West Orchard Avenue", "Querufer 209"]}),
        ("clé au 172 ter allée des Ormes, 00270 Ville. llave a Avenida del Molino n.º 188, 00480 Villa", {"address": ["172 ter allée des Ormes", "Avenida del Molino n.º 188"]}),
        ("Thanks to Corvina B. Starbrook and Ashwick, Gerwulf; M. Pellham too. Dr. Dagrun Oberlind's note", {"name": ["Corvina B. Starbrook", "Ashwick, Gerwulf", "M. Pellham", "Dagrun Oberlind"]}),
        ("HILDRUN WEISSHÜGEL and Élodine Fontclair; Corvina alone. Blast Radius and Quiet Harbor are code names", {"name": ["HILDRUN WEISSHÜGEL", "Élodine Fontclair"]}),
        ("Geprüft von Montverde, Bertholt. <corvina.starbrook@x.example>", {"name": ["Montverde, Bertholt"], "email": ["corvina.starbrook@x.example"]}),
        ("", {}),
    ],
)
def test_detection(text, want):
    assert kinds(text) == want


def test_surrogates_keep_text_shape_and_identity():
    s = personal.Surrogates(b"key")
    text = "Frau Corvina Starbrook (c.starbrook@x.example, SSN 910 27 5355) met Gerwulf Ashwick. Starbrook, Corvina left; C.STARBROOK@X.EXAMPLE, +44 20 7946 0372 and 020 7946 0372."
    out = s.replace(text, personal.find(text, MODEL))
    assert not re.search("Starbrook|Ashwick|910 27|7946", out) and out.startswith("Frau [name ") and " met [name " in out and out.endswith("].")
    marks = re.findall(r"\[(\w+) ([^\]]+)\]", out)
    mails = [v for k, v in marks if k == "email"]
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper()
    phones = [re.sub(r"\D", "", v)[-10:] for k, v in marks if k == "phone"]
    assert phones[0] == phones[1]
    names = [v for k, v in marks if k == "name"]
    assert sorted(re.findall(r"\w+", names[0].casefold())) == sorted(re.findall(r"\w+", names[2].casefold())) and names[0] != names[1]
    assert re.fullmatch(r"\d{3} \d{2} \d{4}", next(v for k, v in marks if k == "id_number"))
    assert s.replace(text, personal.find(text, MODEL)) == out and personal.Surrogates(b"other").replace(text, personal.find(text, MODEL)) != out


def test_permutation_is_one_to_one():
    s = personal.Surrogates(b"k")
    for n in (1, 2, 3):
        assert len({s.permute(str(i).zfill(n), "0123456789", "t") for i in range(10**n)}) == 10**n


def test_rows(spark):
    df = spark.createDataFrame([(1, "mail a@b.example and a@b.example", "q"), (2, None, "q"), (3, "", "q"), (3, "", "q"), (4, "x " * 100_000 + "c@d.example", "q")], "doc_id long, text string, pii_type string")
    got = personal.find_personal(df, MODEL).select("doc_id", "pii_type", "pii_value").distinct().collect()
    assert {tuple(x) for x in got} == {(1, "email", "a@b.example"), (4, "email", "c@d.example")}
    clean = {x.doc_id: (x.text, x.entities) for x in personal.redact(df, MODEL, b"k").collect()}
    assert clean[2] == (None, 0) and clean[3] == ("", 0) and clean[1][1] == 2
    assert personal.find_personal(df.where("false"), MODEL).count() == 0


def test_surrogates_stay_distinct_over_the_corpus():
    s = personal.Surrogates(b"k")
    letters = "abcdefgh"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters] + [a + b + c for a in letters for b in letters for c in letters] + ["josé", "jose", "jösé", "weiß", "weiss"]
    for tag, ending in (("name", ""), ("given", "a"), ("street", "")):
        assert len({s.word(w, tag, ending) for w in words}) == len({w.casefold() for w in words})
    assert s.word("SMITH", "name") == s.word("Smith", "name").upper() == s.word("smith", "name").upper()


def test_initials_and_genders_agree():
    s = personal.Surrogates(b"k")
    full, short = s.name("Gerwulf Ashwick", False), s.name("G. Ashwick", None)
    assert short == f"{full[0]}. {full.split()[1]}" and full.split()[0].endswith("o") and s.name("Corvina Ashwick", True).split()[0].endswith("a")
    text = "Herr Corvina Starbrook wrote. Corvina Starbrook left, and C. Starbrook too."
    marks = re.findall(r"\[name ([^\]]+)\]", s.replace(text, personal.find(text, MODEL)))
    assert marks[0] == marks[1] and marks[2] == f"{marks[0][0]}. {marks[0].split()[1]}"


def test_scripts_are_kept():
    s = personal.Surrogates(b"k")
    model = personal.NameModel(["Иван Петров", "Νίκος Παπαδάκης"], ["слово", "λέξη"])
    text = "Пишет Иван Петров, και ο Νίκος Παπαδάκης."
    found = personal.find(text, model)
    assert [text[a:b] for a, b, _ in found] == ["Иван Петров", "Νίκος Παπαδάκης"]
    a, b = re.findall(r"\[name ([^\]]+)\]", s.replace(text, found))
    assert re.fullmatch("[А-Яа-яЁё ]+", a) and a != "Иван Петров" and all("GREEK" in __import__("unicodedata").name(c) for c in b if c.isalpha())
    assert s.word("王伟", "name") != "王伟" and len(s.word("王伟", "name")) == 2


def test_no_break_spaces_in_numbers():
    assert kinds("tel +33\xa06\xa012\xa034\xa056\xa078") == {"phone": ["+33\xa06\xa012\xa034\xa056\xa078"]}


def test_joined_names_equal_held_ones(spark):
    texts = ["Thanks to Corvina B. Starbrook and Ashwick, Gerwulf; M. Pellham too.", "HILDRUN WEISSHÜGEL met Élodine Fontclair", None, "", "nobody"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    rows = [(g.casefold(), True, False) for g in GIVEN] + [(f.casefold(), False, True) for f in FAMILY]
    words = spark.createDataFrame(rows, "word string, given boolean, family boolean")
    held = {tuple(r) for r in personal.find_personal(docs, MODEL).collect()}
    joined = {tuple(r) for r in personal.find_personal(docs, personal.KnownNames(MODEL.knowing([], []), words)).collect()}
    assert held == joined and len(held) == 10
    assert personal.redact(docs, personal.KnownNames(MODEL.knowing([], []), words), b"k").count() == 10
