"""Garbled text made from clean text is found and restored."""

import random
import unicodedata

import pytest
from conftest import rows

from seamline.llm import encodings as en

class Chain:
    """The bytes of the text in one encoding read as another, some times over."""

    def __init__(self, true, wrong, times):
        self.true, self.wrong, self.times = true, wrong, times

    def garble(self, text):
        for _ in range(self.times):
            text = "".join(self.char(b) for b in text.encode(self.true))
        return text

    def char(self, byte):
        try:
            return bytes([byte]).decode(self.wrong)
        except UnicodeDecodeError:
            return chr(byte)


WORDS = "mémoire protège répertoire décode système préfixe Größe Schlüssel gewöhnliche höchstens wählt prüft configuração apagará não coração índice tamaño página núcleo también señal café".split()
RUSSIAN = "после запуска буфер хранит новый вектор если файл пуст узел никогда читает старый блок параметр проверяет".split()


def sentence(rng):
    if rng.random() < 0.3:
        return " ".join(rng.choices(RUSSIAN, k=8)).capitalize() + "."
    return "The worker " + " ".join(rng.choices(WORDS, k=8)) + " ends."


def corpus(seed=1):
    rng = random.Random(seed)
    clean = {i: " ".join(sentence(rng) for _ in range(4)) for i in range(400)}
    chains = [Chain("utf-8", "cp1252", 1), Chain("utf-8", "latin-1", 1), Chain("utf-8", "cp437", 1), Chain("utf-8", "mac_roman", 1), Chain("utf-8", "cp1251", 1), Chain("utf-8", "cp1252", 2)]
    garbled = {i: chains[i % len(chains)].garble(clean[i]) for i in range(60)}
    for i in range(60, 70):  # bytes of one encoding that were not valid in the other
        clean[i] = "The worker " + " ".join(rng.choices(WORDS, k=20)) + " ends."
        garbled[i] = clean[i].encode("cp1252").decode("utf-8", errors="replace")
    clean[70] = clean[71] = "The worker mémoire ends."
    garbled[70] = "The worker m&#195;&#169;moire ends."
    return clean, garbled


def share_restored(back, garbled, clean):
    """Part of the misread words that came back."""
    words = [(g, r, c) for i in back for g, r, c in zip(garbled[i].split(" "), back[i].split(" "), clean[i].split(" "), strict=True) if g != c]
    return sum(r == c for _, r, c in words) / len(words)


def test_found_and_restored(spark):
    clean, garbled = corpus()
    texts = {**clean, **garbled, 500: "Only quotes `Ã©` and `â€™` here, mémoire.", 501: "ÂNGULO, Ã, ÑANDÚ", 502: "日本語 ┌──┐ α ≤ β 🚀", 503: "café Größe", 504: "", 505: "ascii only", 506: "8× of « a »"}
    data = [(i, t, "x") for i, t in texts.items()] + [(0, texts[0], "again"), (None, "Ã©", "x"), (600, None, "x"), (601, "plain é " * 100_000, "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, word string")
    found = {r.id for r in en.garbled_records(df).collect()}
    changed = {i for i in garbled if garbled[i] != clean[i]}
    assert found == changed
    back = {r.id: r for r in en.restored_records(df).collect()}
    assert share_restored({i: back[i].restored for i in changed if i < 60}, garbled, clean) > 0.9
    assert back[70].restored == clean[70]
    lost = [i for i in changed if 60 <= i < 70]
    assert sum(back[i].restored == clean[i] for i in lost) >= 0.8 * len(lost)
    assert all(back[i].complete == ("�" not in back[i].restored) for i in lost)


def test_single_byte_chains(spark):
    rng = random.Random(4)
    clean = {i: "The worker " + " ".join(rng.choices(WORDS, k=12)) + " ends." for i in range(100)}
    wrong = Chain("cp1252", "cp1251", 1)
    texts = {i: wrong.garble(t) if i < 5 else t for i, t in clean.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert rows(en.garbled_records(df)) == [(i,) for i in range(5)]
    assert share_restored({r.id: r.restored for r in en.restored_records(df).collect()}, texts, clean) > 0.9


def test_many_copies_of_a_garbled_text(spark):
    clean, garbled = corpus()
    texts = {**clean, **garbled} | {10_000 + i: garbled[0] for i in range(2000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    expected = {i for i in garbled if garbled[i] != clean[i]} | set(range(10_000, 12_000))
    assert {r.id for r in en.garbled_records(df).collect()} == expected


@pytest.mark.parametrize("chain", [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1251", "cp1252"), ("koi8-r", "cp1251")])
def test_more_garbled_than_clean(spark, chain):
    """Most texts of a language are misread, all of them different, with a few clean ones beside them."""
    rng = random.Random(9)

    def russian():
        return " ".join(" ".join(rng.choices(RUSSIAN, k=8)).capitalize() + "." for _ in range(4))

    wrong = Chain(*chain, 1)
    latin = {i: " ".join("The worker " + " ".join(rng.choices(WORDS, k=8)) + " ends." for _ in range(4)) for i in range(100)}
    clean = {i: russian() for i in range(100, 240)}
    texts = {**latin, **clean} | {i: wrong.garble(clean[i]) for i in range(100, 200)}
    texts |= {400 + i: unicodedata.normalize("NFD", russian()) for i in range(3)}  # another form of the same letters
    texts |= {300 + i: f"The worker takes 8×\xa0{w} here." for i, w in enumerate(["of", "as", "more", "it", "that"])}  # valid bytes by chance
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert rows(en.garbled_records(df)) == [(i,) for i in range(100, 200)]
    back = {r.id: r.restored for r in en.restored_records(df).collect()}
    assert share_restored(back, texts, clean) > (0.85 if chain[0] == "koi8-r" else 0.9)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert en.garbled_records(none).count() == 0 and en.restored_records(none).count() == 0
    assert en.garbled_records(spark.createDataFrame([(1, "une mémoire")], "doc_id bigint, text string")).count() == 0


def test_alignment():
    assert en._runs("lâ€™opÃ©rateur 10,5") == {1: "â€™", 3: "Ã©"}
    assert en._differences("dÃ©bit", "débit") == [("Ã©", "é")] and en._differences("x—débit", "débit") is None
    assert en.pieces("Ð¿Ñ€Ð¸", "при", {}, {}) == [("Ð¿", "п"), ("Ñ€", "р"), ("Ð¸", "и")]
    assert set(en.pieces("â€œÃ©", "“é", {"Ã©": "é"}, {"é": ["Ã©"]})) == {("â€œ", "“"), ("Ã©", "é")}
    assert en.pieces("abcde", "xy", {}, {}) == []
    assert not en._sequence("“é", "é") and not en._sequence("”—", "…") and en._sequence("Â°", "°")


def test_an_encoding_that_is_in_no_list(spark):
    """Letters written as made-up pairs of characters: the mapping can only come from aligned twins."""
    rng = random.Random(12)
    made_up = {c: "ÞÐðþŊŋ"[i % 6] + "§¶†‡"[i // 6 % 4] for i, c in enumerate("éèàçùâêîôûäöüßñãõíóúá")}
    clean = {i: " ".join("The worker " + " ".join(rng.choices(WORDS, k=8)) + " ends." for _ in range(3)) for i in range(120)}
    texts = {i: "".join(made_up.get(c, c) for c in t) if i < 20 else t for i, t in clean.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.id for r in en.garbled_records(df).collect()} == set(range(20))
    assert all(r.restored == clean[r.id] for r in en.restored_records(df).collect())


def test_long_words(spark):
    """Text without spaces is one long word; it is learned from and restored as any other."""
    rng = random.Random(3)
    clean = {i: "begin" + "".join(rng.choices("abcdeéèàü", k=900)) + "end" for i in range(6)}
    texts = {**clean} | {10 + i: Chain("utf-8", "cp1252", 1).garble(clean[i]) for i in range(3)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert rows(en.garbled_records(df)) == [(10,), (11,), (12,)]
    assert all(r.restored == clean[r.id - 10] for r in en.restored_records(df).collect())


def test_all_variants_of_a_key_are_aligned():
    """A garbled form and its clean one find each other however many more frequent variants their key has."""
    import pyarrow as pa

    letters = [chr(c) for c in range(0x3B1, 0x3B1 + 60) if chr(c).isalpha()][:40]
    words = [*(f"d{c}bit" for c in letters), "dÃ©bit", "débit"]
    batch = pa.record_batch([pa.array([1] * len(words)), pa.array(words), pa.array([*[9] * len(letters), 2, 1])], names=["key", "word", "n"])
    found = {(r["garbled"], r["clean"]): r["n"] for b in en._twins(iter([batch])) for r in b.to_pylist()}
    assert found[("dÃ©bit", "débit")] == 2
