import pytest

from tessellum.llm import quality as Q

PROSE = {
    "ru": "Вчера вечером мы долго шли по берегу реки и говорили о том, что случилось в городе. Никто не хотел возвращаться домой, потому что погода была хорошая.",
    "sv": "Igår kväll gick vi länge längs floden och talade om vad som hade hänt i staden. Ingen ville gå hem eftersom vädret var så fint.",
    "pl": "Wczoraj wieczorem długo szliśmy brzegiem rzeki i rozmawialiśmy o tym, co wydarzyło się w mieście. Nikt nie chciał wracać do domu, ponieważ pogoda była piękna.",
    "fi": "Eilen illalla kävelimme pitkään joen rannalla ja puhuimme siitä, mitä kaupungissa oli tapahtunut. Kukaan ei halunnut palata kotiin, koska sää oli kaunis.",
    "eu": "Atzo arratsaldean ibaiaren ertzean luzaroan ibili ginen eta hirian gertatutakoari buruz hitz egin genuen. Inork ez zuen etxera itzuli nahi, eguraldia ederra zelako.",
    "tr": "Dün akşam nehir kıyısında uzun süre yürüdük ve şehirde olanlar hakkında konuştuk. Hava güzel olduğu için kimse eve dönmek istemedi.",
    "hi": "कल शाम हम नदी के किनारे बहुत देर तक चलते रहे और शहर में जो हुआ उसके बारे में बात करते रहे। मौसम अच्छा था इसलिए कोई घर नहीं लौटना चाहता था।",
    "ar": "مشينا مساء أمس طويلا على ضفة النهر وتحدثنا عن ما حدث في المدينة. لم يرغب أحد في العودة إلى البيت لأن الطقس كان جميلا.",
    "ko": "어제 저녁 우리는 강변을 오랫동안 걸으며 도시에서 일어난 일에 대해 이야기했다. 날씨가 좋아서 아무도 집에 돌아가고 싶어 하지 않았다.",
    "ja": "昨日の夜、私たちは川沿いを長い間歩いて、町で何が起こったかについて話しました。天気がよかったので、誰も家に帰りたがりませんでした。",
    "th": "เมื่อคืนนี้พวกเราเดินเล่นริมแม่น้ำเป็นเวลานานและพูดคุยเกี่ยวกับสิ่งที่เกิดขึ้นในเมือง ไม่มีใครอยากกลับบ้านเพราะอากาศดีมาก",
    "caps": "EVERY MORNING THE KEEPER OF THE MILL WALKS TO THE BRIDGE AND COUNTS THE BOATS THAT CAME IN DURING THE NIGHT.",
    "wrapped": "The keeper of the mill walks to the bridge\nevery morning and counts the boats that came\nin during the night, as the town has asked.",
}
JUNK = {
    "fi list": "talo, auto, kissa, koira, hevonen, lehmä, lammas, sika, kana, ankka, hanhi, kalkkuna, kyyhkynen, varis, harakka",
    "sv list": "- röd stol\n- blå bord\n- grön lampa\n- vit dörr\n- svart tak\n- gul vägg",
    "ru records": "Иванов Пётр; Москва; 1987\nСидоров Илья; Казань; 1990\nПетрова Анна; Тверь; 1979",
    "ko list": "사과\n바나나\n포도\n딸기\n수박\n복숭아\n참외",
    "salad": "please table notes opinion from which compared missing typing column longer list printed exported that column sample",
    "noise": "wr3em%y5z2^ kqdcr l85aj#x9l37 u34ksl6zhcc5n o6hoql1eb^no4 okhh3l75q9fb",
    "twice": "The keeper of the mill walks to the bridge and counts the boats.\n\n" * 4,
    "phrase": "same phrase, " * 40,
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(f"+{k}", v) for k, v in PROSE.items()] + [(f"-{k}", v) for k, v in JUNK.items()]
    rows += [("+null", None), ("+empty", ""), ("+blank", " \n\t ")]
    df = spark.createDataFrame([(n, *r, "x") for n, r in enumerate(rows)], "doc_id long, name string, text string, n_words string")
    found = {r.doc_id for r in Q.describe(df, "doc_id", "text").where(Q.is_junk()).collect()}
    return {r[0] for n, r in enumerate(rows) if n in found}


@pytest.mark.parametrize("name", [*PROSE, "null", "empty", "blank"])
def test_prose_of_any_language_is_no_junk(judged, name):
    assert f"+{name}" not in judged


@pytest.mark.parametrize("name", JUNK)
def test_lists_records_and_junk_are_found(judged, name):
    assert f"-{name}" in judged


def test_answers_do_not_depend_on_the_memory(monkeypatch):
    texts = [*PROSE.values(), *JUNK.values()]
    want = [Q.statistics(t) for t in texts]
    monkeypatch.setattr(Q, "KEEP", 3)
    assert [Q.statistics(t) for t in texts] == want


def test_common_words_are_counted_over_all_texts(spark):
    df = spark.createDataFrame([("a b",), ("A c",), (None,), ("a a d",)], "text string")
    assert Q.common_words(df, "text", 50) == ["a"]
    assert Q.statistics("a x", frozenset(["a"]))[list(Q.COLUMNS).index("common_words")] == 0.5


def test_long_text_is_read_whole():
    assert Q.statistics("| a | 1 |\n" * 50_000 + PROSE["sv"])[1] > 250_000
