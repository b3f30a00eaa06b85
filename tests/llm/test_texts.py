import random

import pytest
from pyspark.sql import functions as F

from gleanstone.llm import bpe, detect, languages, offensive, pair_defects, personal_data, source_mix, surrogates
from gleanstone.llm.crf import ChainCRF
from gleanstone.llm.kneser_ney import ClassModels

TEXTS = ["Hello world, don't!", "", None, "  tabs\t\tand   blanks  \n\n x", "日本語 テキスト 🙂 naïve", "<|endoftext|> is text", "a" * 3000, "xyz" * 2000 + " end", "1234567 8.5e-3", "\x00\x01﻿", "नमस्ते", "word " * 20_000]


def test_tokens_equal_the_public_encoder(spark):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(bpe.vocabulary_path())
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash"), (None, "x", "")], "doc_id bigint, text string, ids string")
    got = bpe.encode_corpus(df).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "x" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert r["ids"] == (public.encode_ordinary(text) if text else [])
        assert public.decode(r["ids"]) == (text or "")
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df.where("doc_id is not null"), ["doc_id"]).collect()}
    assert counts[2] == 0 and counts[0] == len(public.encode_ordinary(TEXTS[0]))


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh ", bytes(range(256))])
def test_long_words_merge_alike(alphabet, monkeypatch):
    rng, ranks = random.Random(1), bpe.read_ranks(bpe.vocabulary_path())
    for n in (1, 2, 129, 400):
        word = bytes(rng.choice(alphabet) for _ in range(n))
        long = bpe._encode_long(word, ranks)
        monkeypatch.setattr(bpe, "LONG_WORD", 10**9)
        assert long == bpe.encode_word(word, ranks) or word in ranks
        assert b"".join({v: k for k, v in ranks.items()}[i] for i in long) == word


def docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(5, 60))), rng.choices(["big", "mid", "small", None, "unlisted"], [20, 8, 1, 1, 2])[0]) for i in range(600)]
    return spark.createDataFrame(rows + rows[:30] + [(9001, None, "big"), (9002, "", "mid"), (None, "x", "big")], "doc_id bigint, text string, source string")


TARGETS = [("big", 0.5, 2), ("mid", 0.4, 3), ("small", 0.1, 2), ("missing", 0.2, 5), ("zero", None, None), (None, 0.1, 1)]


def test_mixture(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_weight double, max_repeats int")
    rows = source_mix.mix(docs(spark), targets, total_tokens=20_000, shards=5).collect()
    caps = {s: r for s, _, r in TARGETS}
    uses, tokens = {}, {}
    for r in rows:
        uses[r["source"], r["doc_id"]] = uses.get((r["source"], r["doc_id"]), 0) + 1
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"]
    assert all(n <= caps[s] for (s, _), n in uses.items()) and len({(r["doc_id"], r["pass"]) for r in rows}) == len(rows)
    held = {}
    for r in source_mix.sized(docs(spark)).collect():
        held[r["source"]] = held.get(r["source"], 0) + r["n_tokens"]
    for s, w, cap in TARGETS[:3]:
        want = min(w * 20_000, cap * held[s])
        assert want - 70 <= tokens[s] <= want
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["position"] for r in rows if r["shard"] == shard) == list(range(1, sum(r["shard"] == shard for r in rows) + 1))
    again = source_mix.mix(docs(spark).repartition(5), targets, total_tokens=20_000, shards=5).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}
    told = {r["source"]: r for r in source_mix.shares(docs(spark), targets, 20_000).collect()}
    assert told["missing"]["missed_because"] == "no documents" and told["small"]["missed_because"] == "repetition cap" and told["big"]["missed_because"] == "other sources fall short" and told["zero"]["missed_because"] is None
    assert abs(told["big"]["share_of_wanted"] - 0.5) < 0.01 and told["big"]["wanted_tokens"] == 10_000
    assert source_mix.mix(docs(spark).limit(0), targets).count() == 0 and source_mix.mix(docs(spark), targets.limit(0)).count() == 0


def test_many_shards_are_dealt_in_subtrees(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "SUBTREES", 3)
    targets = spark.createDataFrame([("big", 0.6, 3), ("mid", 0.4, 3)], "source string, target_weight double, max_repeats int")
    rows = source_mix.mix(docs(spark), targets, total_tokens=20_000, shards=11).collect()
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_tokens"]
    assert set(sizes) == set(range(11)) and len({(r["doc_id"], r["pass"]) for r in rows}) == len(rows)
    assert abs(sum(sizes.values()) - 20_000) < 140 and max(sizes.values()) < 2 * min(sizes.values())
    for shard in range(11):
        mine = [r for r in rows if r["shard"] == shard]
        assert 0.4 < sum(r["n_tokens"] for r in mine if r["source"] == "big") / sizes[shard] < 0.8


def test_splitting_tree_is_exact():
    import numpy as np

    quotas = np.array([7, 0, 400, 33])
    dealt = source_mix.split_quotas(quotas, [1] * 7, np.random.default_rng(1))
    assert dealt.shape == (7, 4) and (dealt.sum(axis=0) == quotas).all() and dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 3


KEY = "a key of the tests"
FOUND = [
    ("Write to bob.smith+x@mail.example please", [("EMAIL", "bob.smith+x@mail.example")]), ("at ann (at) mail (dot) example (dot) org ok", [("EMAIL", "ann (at) mail (dot) example (dot) org")]), ("I follow @ann_help", []), ("u/a.b@c.example/x", [("EMAIL", "a.b@c.example")]),
    ("Call +44 20 7946 0555 or (555) 010-2020", [("PHONE", "+44 20 7946 0555"), ("PHONE", "(555) 010-2020")]), ("tel 01.99.00.11.22", [("PHONE", "01.99.00.11.22")]), ("on 2026-01-05 or 05-01-2026", []), ("Invoice 9941-2297, order 5765-765", []), ("firmware 4.3.0.7.1", []),
    ("card 4242 4242 4242 4242", [("IDENTITY", "4242 4242 4242 4242")]), ("old order 4242424242424241", []), ("iban DE89 3704 0044 0532 0130 00 thanks", [("IDENTITY", "DE89 3704 0044 0532 0130 00")]), ("ssn 937-67-2809", [("IDENTITY", "937-67-2809")]), ("passport XK1234567", [("IDENTITY", "XK1234567")]), ("Steuer-ID 00 963 915 094", [("IDENTITY", "00 963 915 094")]), ("serial 478810645592081910722717", []),
    ("Send it to 12B Oak Street now", [("ADDRESS", "12B Oak Street")]), ("Flat 3, 12 Oak Lane, Town XQ1 4ZZ please", [("ADDRESS", "Flat 3, 12 Oak Lane, Town XQ1 4ZZ")]), ("Eichenstraße 12 und", [("ADDRESS", "Eichenstraße 12")]), ("12 bis Rue des Lilas, Ville", [("ADDRESS", "12 bis Rue des Lilas, Ville")]), ("Calle del Sol 5, 3º B", [("ADDRESS", "Calle del Sol 5, 3º B")]), ("Width 20 x 40 cm, batch 12 Square tiles", []),
    ("This is Ann O'Dell writing.", [("NAME", "Ann O'Dell")]), ("Ask for Dr. Dell at noon", [("NAME", "Dr. Dell")]), ("Herr Dr. Klaus von Dell", [("NAME", "Herr Dr. Klaus von Dell")]), ("my neighbour Has The same", []), ("Regards, van Dell, Ann", [("NAME", "van Dell, Ann")]), ("this is ann dell writing", [("NAME", "ann dell")]), ("this is off limits for me", []), ("Kind regards\nyour team", []), ("The Mr Bristle box", []), ("the MR BRISTLE box", []), ("See [EMAIL_1] and [NAME_2].", []), ("I spoke to the desk", []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), FOUND)
def test_detection(text, want):
    assert [(s.pii_class, s.value) for s in detect.find(text, ("mr bristle",))] == want


def personal(spark):
    rows = [(f"r{i:02d}", t, None, t[:3] if i % 2 else None, "x" * 9) for i, (t, _) in enumerate(FOUND)] + [("big", "y " * 60_000 + "mail a@b.example", None, None, None), ("nil", None, None, None, None), (None, "a@b.example", None, None, None)]
    return spark.createDataFrame(rows + rows[:6], "record_id string, input_text string, output_text string, feedback string, entity string").selectExpr("*", "cast(null as string) as error")


def test_prefilter_misses_nothing_and_positions_are_code_points(spark):
    got = {(r["record_id"], r["field_name"], r["pii_class"], r["start_pos"]) for r in personal_data.occurrences(personal(spark), KEY, ("mr bristle",)).collect()}
    want = {(f"r{i:02d}", "input_text", s.pii_class, s.start) for i, (t, _) in enumerate(FOUND) for s in detect.find(t, ("mr bristle",))}
    assert want <= got and ("big", "input_text", "EMAIL", 120_005) in got and len(got - want) == 2
    assert personal_data.occurrences(personal(spark).limit(0), KEY).count() == 0


GATED = [
    "my ssn #123-45-6789", "ssn/123-45-6789", "ssn+123-45-6789", "I live at 12 B rue Victor Hugo", "ring 001(555)123-4567 soon", "00 1", "_DE89370400440532013000", "Mr X", "Eichenstraße     12 und", "Calle. Sol 5 ok", "Flat A12 Oak Lane now", "12 B2 Street x",
    "ssn 123\x1c45\x1c6789", "tel +\u0664\u0664 \u0662\u0660 \u0667\u0669\u0664\u0666 \u0660\u0665\u0665\u0665", "pa\u017f\u017fport XK1234567", "ssn 123-45-6789", "DE89 3704 0044 0532 0130 00", "AB 12 34 56 C", "X1234567L 12345678Z", "4242.4242.4242.4242", "00 44 20 7946 0555", "0044 20 7946 0555", "555-010-2020",
    "01.99.00.11.22", "030/1234567", "12 bis Rue des Lilas", "apt 3, 12 oak lane", "12 Oak\u00a0Lane", "ann [at] mail [dot] example [dot] org", "numéro\u2003fiscal 12345678", "Personalausweis T220001293", "Ann Dell from  the night desk has it", "Avda. Sol 5", "The technician, Xeno Quill, left", "contact Xeno\u00a0van Quill", "Ivan Quill", "скажите Ивану Петрову", "водитель Тимур Галиев",
]


def test_prefilter_passes_every_alternative(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(GATED)], "record_id string, input_text string")
    passed = {r["record_id"] for r in personal_data.suspects(df, fields=("input_text",)).collect()}
    assert [t for i, t in enumerate(GATED) if detect.find(t) and str(i) not in passed] == []
    assert sum(bool(detect.find(t)) for t in GATED) >= 28


def test_names_without_known_phrases():
    """Mentions written for this purpose, and texts that name nobody."""
    from tests.llm.heldout_names import NAMED, UNNAMED

    found = [name in [s.value for s in detect.find(t) if s.pii_class == "NAME"] for t, name in NAMED]
    assert sum(found) >= 0.95 * len(NAMED)
    assert [t for t in UNNAMED if detect.find(t)] == []


def test_a_key_is_required():
    with pytest.raises(ValueError, match="key"):
        personal_data.entity_digest(detect.Span(0, 1, "NAME", "name", "x"), "")


def test_redaction_keeps_the_rest(spark):
    for style in ("placeholder", "surrogate"):
        out = {r["record_id"]: r for r in personal_data.redacted(personal(spark), KEY, ("mr bristle",), style=style).collect()}
        for i, (text, _) in enumerate(FOUND):
            new, at = out[f"r{i:02d}"]["input_text"], 0
            for s in detect.find(text, ("mr bristle",)):
                assert s.value not in new
                head = text[at : s.start]
                assert head in new
                at = s.end
            assert new.endswith(text[at:])
        assert out["nil"]["input_text"] is None and out["r00"]["entity"] == "x" * 9
    assert personal_data.redacted(personal(spark), KEY).count() == personal(spark).count()


def test_placeholders_tell_entities_apart_beyond_32_bits(spark, monkeypatch):
    # Two entities whose digests agree in their first eight digits.
    monkeypatch.setattr(personal_data, "entity_digest", lambda span, key: "1f2e3d4c" + span.value[:1].encode().hex() * 8)
    df = spark.createDataFrame([("1", "write to ann@mail.example or bob@mail.example")], "record_id string, input_text string")
    text = personal_data.redacted(df, KEY, fields=("input_text",)).collect()[0]["input_text"]
    assert text == f"write to [EMAIL_1f2e3d4c{'61' * 8}] or [EMAIL_1f2e3d4c{'62' * 8}]"


def test_surrogates_keep_type_and_format():
    span = lambda c, k, v: detect.Span(0, len(v), c, k, v)
    card = surrogates.replacement(span("IDENTITY", "card", "4242-4242-4242-4242"), KEY)
    assert detect.luhn(card.replace("-", "")) and card[4] == "-" and card.startswith("4242")
    assert detect.iban_ok(surrogates.replacement(span("IDENTITY", "iban", "DE89 3704 0044 0532 0130 00"), KEY).replace(" ", ""))
    a, b, c = (surrogates.replacement(span("NAME", "name", v), KEY) for v in ("Mrs Ann Dell", "DELL, ANN", "Mr Dell"))
    assert a.split()[2].lower() == b.split(",")[0].lower() == c.split()[1].lower() and b.isupper() and a.startswith("Mrs ")
    assert surrogates.canonical(span("NAME", "name", "Mr  Ann Dell")) == surrogates.canonical(span("NAME", "name", "Dell, Ann"))
    assert surrogates.replacement(span("PHONE", "phone", "+44 20 7946 0555"), KEY)[:5] == "+44 2"
    assert " (at) " in surrogates.replacement(span("EMAIL", "email", "ann (at) mail (dot) example"), KEY)


def test_colliding_surrogates_are_told_apart(spark, monkeypatch):
    rows = [(f"e{i}", "NAME", "name", f"Ann{i} Dell") for i in range(6)]
    found = spark.createDataFrame(rows, "entity string, pii_class string, kind string, value string")
    out = personal_data.entities(found, KEY).collect()
    assert len({r["surrogate"] for r in out}) == 6


def test_mentions_of_one_entity_share_one_surrogate(spark, monkeypatch):
    texts = ["Regards, Frau Garrick Brackwater", "Regards, Garrick Brackwater", "Regards, BRACKWATER, GARRICK", "Ask for Dr. Dell at noon", "Regards, Dell", "Tel. +44 20 7946 0555", "Tel. 0044 20 7946 0555"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "record_id string, input_text string")
    known = lambda: {r["record_id"]: r for r in personal_data.occurrences(df, KEY, fields=("input_text",)).collect()}
    form = lambda r: surrogates.canonical(detect.Span(0, 0, r["pii_class"], r["kind"], r["surrogate"]))
    rows = known()
    assert len(rows) == len(texts)
    for same in ("012", "34", "56"):
        assert len({rows[i]["entity"] for i in same}) == len({form(rows[i]) for i in same}) == 1
    assert rows["0"]["surrogate"].startswith("Frau ") and rows["2"]["surrogate"].isupper()
    # The text gets what the list of occurrences says, also for entities that had to draw again or got a mark.
    real = personal_data.entities
    for attempt in (0, 1, -1):
        monkeypatch.setattr(personal_data, "entities", lambda found, key, n=attempt: real(found, key).withColumn("attempt", F.lit(n)))
        drawn = known()
        out = {r["record_id"]: r["input_text"] for r in personal_data.redacted(df, KEY, style="surrogate", fields=("input_text",)).collect()}
        assert out == {i: texts[int(i)].replace(r["value"], r["surrogate"]) for i, r in drawn.items()}
        assert (drawn["0"]["surrogate"] == rows["0"]["surrogate"]) == (attempt == 0) and drawn["0"]["surrogate"].endswith(drawn["0"]["entity"]) == (attempt < 0)


PAIRS = [
    ("Why is my lamp dark?", "Please press the button and wait ten minutes.", None, None), ("Why is my lamp dark?", "Done - refund of 12 EUR issued", None, None), ("Why is my lamp dark?", None, None, "empty"), ("Why?", " — ", None, "empty"), ("Why?", "N/A", None, "empty"), ("Why?", None, "boom", None), ("Why?", "", "boom", None),
    ("Why is my lamp dark?", "Please press the button. Then wait until the", None, "truncated"), ("Why is my lamp dark?", "Please press the button. Then wait… [truncated]", "stream ended: length", "truncated"), ("Why?", '{"summary": "Please press the button.", "steps": ["Wait un', None, "truncated"),
    ("Why is my lamp dark?", "Sorry! I'm not able to discuss that request. Thank you for your understanding.", None, "refusal"), ("Warum ist meine Lampe dunkel und kalt?", "Diese Anfrage darf ich nicht beantworten.", None, "refusal"),
    ("Why is my lamp dark? It is order 12.", "WHY IS MY LAMP DARK? IT IS ORDER 12.", None, "echo"), ("Why is my lamp dark? It is order 12.", "You asked: Why is my lamp dark? It is order 12. Please press the button and wait ten minutes.", None, None),
    ("Why is my lamp dark after the update?", "Bitte ziehen Sie den Stecker und warten Sie zehn Minuten.", None, "wrong_language"), ("Why is my lamp dark? Please answer in German.", "Bitte ziehen Sie den Stecker und warten Sie zehn Minuten.", None, None),
    ("What is 2+2?", "4", None, None), ("Is it red or blue?", "Red", None, None), ("How do I reset my lamp?", "how do I reset my lamp", None, "echo"), ("Die Straße ist lang und das Paket kam nicht an.", "DIE STRASSE IST LANG UND DAS PAKET KAM NICHT AN.", None, "echo"),
    ("Why is my lamp dark after the update?", "Проверьте, пожалуйста, кабель и подождите десять минут.", None, "wrong_language"), ("Why is my lamp dark after the update?", "Controleer de kabel en wacht tien minuten, dan werkt het weer.", None, "wrong_language"), ("Why is my lamp dark after the update?", "Kontrollera kabeln och vänta i tio minuter.", None, "wrong_language"),
    ("Why is my lamp dark after the update?", "请检查电缆，然后等待十分钟。", None, "wrong_language"), ("Why is my lamp dark after the update?", "يرجى فحص الكابل والانتظار عشر دقائق.", None, "wrong_language"), ("Why is my lamp dark? Please answer in Dutch.", "Controleer de kabel en wacht tien minuten, dan werkt het weer.", None, None),
    ("为什么我的灯不亮？", "请检查电缆，然后等待十分钟。", None, None), ("Почему лампа не горит?", "Проверьте, пожалуйста, кабель и подождите десять минут.", None, None), ("Waarom is mijn lamp donker?", "Controleer de kabel en wacht tien minuten.", None, None), ("Why is my lamp dark?", "That request is not one I can take on.", None, "refusal"),
    ("Why is my lamp dark?", "I am unable to see your lamp from here, so please read the number on its back.", None, None), ("Why is my lamp dark?", "Steps:\n1. Press the button\n2. Wait ten minutes", None, None), (None, "Please press the button and wait.", None, None), ("Why is my lamp dark?", "Please press the button and wait. " * 3000, None, None),
]


def test_pair_defects(spark):
    rows = [(f"p{i:02d}", *p[:3]) for i, p in enumerate(PAIRS)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:4]], "record_id string, input_text string, output_text string, error string, defect string")
    got = {r["record_id"]: r["defect"] for r in pair_defects.defective_pairs(df).collect()}
    assert got == {f"p{i:02d}": p[3] for i, p in enumerate(PAIRS) if p[3]}
    assert pair_defects.tag_pairs(df).count() == len(rows) + 4 and pair_defects.defective_pairs(df.limit(0)).count() == 0


def test_field_learns_and_decodes_like_brute_force():
    import itertools

    import numpy as np

    rng = random.Random(3)
    field = ChainCRF(("a", "b", "c"))
    data = [[([f"x{label}" if rng.random() < 0.9 else "noise", "always"], label) for label in rng.choice((["a", "b"], ["b", "c", "a"], ["a"], ["c", "c"]))] for _ in range(200)]
    field.fit(data, rounds=120)
    emissions = [np.array([field.emission(f) for f, _ in seq]) for seq in data[:30]]
    for e, path in zip(emissions, field.decode(emissions)):
        best = max(itertools.product(range(3), repeat=len(e)), key=lambda p: sum(e[t, k] for t, k in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:])))
        assert tuple(path) == best


LANGUAGES = [
    ("it", "Il pacco è arrivato ieri, ma manca il cavo."), ("nl", "Het pakket is gisteren aangekomen, maar de kabel ontbreekt."), ("sv", "Paketet kom igår, men kabeln saknas."), ("pl", "Paczka przyszła wczoraj, ale brakuje kabla."), ("cs", "Balík přišel včera, ale chybí kabel."), ("ro", "Pachetul a sosit ieri, dar lipsește cablul."),
    ("hu", "A csomag tegnap megérkezett, de hiányzik a kábel."), ("tr", "Paket dün geldi ama kablo eksik."), ("fi", "Paketti tuli eilen, mutta johto puuttuu."), ("hr", "Svjetiljku možete preuzeti kod nas sutra."), ("ca", "Podeu recollir el llum demà a la botiga."), ("id", "Anda dapat mengambil lampu itu besok di toko kami."), ("vi", "Bạn có thể lấy đèn vào ngày mai tại cửa hàng."),
    ("en", "You can pick the lamp up at our shop tomorrow."), ("de", "Sie können die Lampe morgen bei uns abholen."), ("fr", "Vous pouvez venir chercher la lampe demain."), ("es", "Puede recoger la lámpara mañana en la tienda."), ("pt", "Pode levantar o candeeiro amanhã na loja."), ("ru", "Посылка пришла вчера, но не хватает кабеля."), ("uk", "Посилка прийшла вчора, але немає кабелю."),
    ("zh", "包裹昨天到了，但是缺少电缆。"), ("ja", "荷物は昨日届きましたが、ケーブルがありません。"), ("ko", "소포는 어제 도착했지만 케이블이 없습니다."), ("ar", "وصل الطرد أمس لكن الكابل مفقود."), ("el", "Το δέμα ήρθε χθες αλλά λείπει το καλώδιο."), ("he", "החבילה הגיעה אתמול אבל הכבל חסר."), ("hi", "पार्सल कल आया लेकिन केबल गायब है।"), ("th", "พัสดุมาถึงเมื่อวานแต่ไม่มีสายไฟ"),
]


def test_languages():
    assert [(c, languages.language(t)) for c, t in LANGUAGES if languages.language(t) != c] == []
    assert languages.language("12345 ABC") is None and languages.language("") is None
    assert languages.asked_for("Please answer in Portuguese.") == "pt" and languages.asked_for("bitte antworten Sie auf Deutsch") == "de" and languages.asked_for("answer soon") is None and languages.asked_for("Reply in Russian, please") == "ru"


def test_probabilities_sum_to_one():
    from collections import Counter

    toxic, ordinary = Counter({("you", "fool"): 2, ("you", "are", "mean"): 1}), Counter({("you", "are", "kind"): 3, ("thank", "you"): 2})
    m = ClassModels().fit(toxic, ordinary)
    words = [*m.shared]
    for c in (0, 1):
        for u, v in (("you", "are"), ("\x02", "\x02"), ("no", "where"), ("x", "you")):
            assert abs(sum(m.probability(c, u, v, w) for w in [*words, "unseen"]) - 1) < 1e-9


HARSH = ["Please wait. You are an idiot and everyone on the night desk knows it.", "You are an i d i o t and everyone knows it!", "yоu are an ідіоt and everyone knows it", "go to hell, you b*****d.", "Fuuuuuck you and fuck the whole company", "Halt die Fresse, du dummes Schwein."]
MILD = ["The thing is garbage and I want my money back.", "Kill the child process before you restart the server.", "Abusive or hateful messages are not allowed on this page.", "def f(x):\n  return x ** 2", "日本語の文です。", "Please wait ten minutes.", "", None, "...", "ok " * 50_000]


def test_models_on_sentences_they_never_saw():
    """The development sentences and the held-out ones (mirrored pairs), from the composed sentences alone, without any rating."""
    from gleanstone.llm.offensive_training import sentences_of_classes
    from tests.llm import development_offensive, heldout_offensive

    known = {Ws for part in sentences_of_classes() for s in part if (Ws := offensive.Words()(offensive.plain(s)))}
    scorer = offensive.train([])
    for texts, least_recall, least_precision in ((development_offensive, 0.84, 0.93), (heldout_offensive, 0.73, 0.83)):
        new = lambda part: [t for t in part if offensive.Words()(offensive.plain(t)) not in known]
        bad, good = new(texts.OFFENSIVE), new(texts.ORDINARY)
        hits, wrong = (sum(scorer.document(t) > scorer.threshold for t in part) for part in (bad, good))
        assert len(bad) + len(good) >= 160 and hits / len(bad) >= least_recall and hits / (hits + wrong) >= least_precision


@pytest.mark.parametrize("text", ["Fuck you!", "Stupid bitch.", "Fick dich.", "Idiot!", "You idiot.", "Shut up, bitch.", "Suck my dick.", "I'm going to stab you tonight.", "Your race should be exterminated.", "Jews are subhuman scum.", "fuck you, I want my 30 EUR back"])
def test_insults_of_two_words(text):
    scorer = offensive.train([])
    assert scorer.document(text) > scorer.threshold


@pytest.mark.parametrize("text", ["Hello there.", "You are kind.", "This stupid printer is broken again.", "He was convicted of murder.", "12 34", "Je l'ai déjà redémarré 20 fois.", "Send the label."])
def test_short_or_partly_known_sentences_are_ordinary(text):
    scorer = offensive.train([])
    assert scorer.document(text) <= scorer.threshold


@pytest.mark.parametrize("text", ["Arschloch!", "操你妈", "去死吧 你这个白痴", "死ね この馬鹿野郎", "包裹到了。你这个白痴！"])
def test_insults_of_one_word_and_without_blanks(text):
    scorer = offensive.train([])
    assert scorer.document(text) > scorer.threshold


@pytest.mark.parametrize("text", ["Hello!", "desk:", "荷物が雨の中に置かれていました。", "请打开设备页面，然后按下圆形按钮。"])
def test_ordinary_words_alone_and_without_blanks(text):
    scorer = offensive.train([])
    assert scorer.document(text) <= scorer.threshold


def test_offensive(spark):
    rows = [(i, t, "a") for i, t in enumerate(HARSH)] + [(100 + i, t, None) for i, t in enumerate(MILD)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + rows[:2]], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(100, "x", 0), (105, "x", 0), (0, "x", 1), (0, "y", None), (None, "z", 1)], "doc_id bigint, annotator string, offensive int")
    assert {r["doc_id"] for r in offensive.found(df, labels).collect()} == set(range(len(HARSH)))
    scores = {r["doc_id"]: r["score"] for r in offensive.scores(df, labels).collect()}
    assert scores[106] is None and scores[107] is None and len(scores) == len(rows)
    rates = {r["source"]: (r["documents"], r["offensive"]) for r in offensive.rates(df, labels).collect()}
    assert rates == {"a": (8, 8), None: (10, 0)}
    assert offensive.found(df.limit(0), labels).count() == 0 and offensive.found(df, labels.limit(0)).count() == len(HARSH)
