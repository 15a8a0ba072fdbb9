"""Detection of encodings: the chain's cases, and a confusion table over generated files."""

import random
from collections import Counter

from lexiforge.sources import encodings as E
from pyspark.sql import functions as F

CHINESE = "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家电力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天政四日那社义事平形相全表间样与关各重新线内数正心反你明看原又么利比或但质气第向道命此变条只没结解问意建月公无系军很情者最立代想已通并提直题党程展五果料象员革位入常文总次品式活设及管特件长求老头基资边流路级少图山统接知较将组见计别她手角期根论运农指几九区强放决西被干做必战先回则任取据处队南给色光门即保治北造百规热领七海口东导器压志世金增争济阶油思术极交受联什认六共权收证改清己美再采转更单风切打白教速花带安场身车例真务具万每目至达走积示议声报斗完类八离华名确才科张信马节话米整空元况今集温传土许步群广石记需段研界拉林律叫且究观越织装影算低持音众书布复容儿须际商非验连断深难近矿千周委素技备半办青省列习响约支般史感劳便团往酸历市克何除消构府称太准精值号率族维划选标写存候毛亲快效斯院查江型眼王按格养易置派层片始却专状育厂京识适属圆包火住调满县局照参红细引听该铁价严"
KANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをんアイウエオカキクケコ日本語東京大学時間今年会社人中国"
HANGUL = "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후기니디리미비시이지치키티피히는을를에서의은"


def prose(rng, letters, n=400):
    return "".join(rng.choice(letters) if rng.random() < 0.9 else rng.choice(" \n,.") for _ in range(n))


def test_confusion_table():
    rng = random.Random(1)
    table = Counter()
    traditional = [c for c in CHINESE if c.encode("big5", "ignore")]
    for _ in range(60):
        for name, letters in (("utf-8", CHINESE), ("gb18030", CHINESE), ("big5", traditional), ("utf-16-le", CHINESE + "  ")):
            text = prose(rng, letters)
            got = E.read(text.encode(name))
            table[name, got[1]] += 1
            if got[1] == name:
                assert got[0] == text
        table["shift_jis", E.detected(prose(rng, KANA).encode("shift_jis"))] += 1
        table["euc_kr", E.detected(prose(rng, HANGUL).encode("euc_kr"))] += 1
    right = {name: table[name, name] for name in ("utf-8", "gb18030", "big5", "utf-16-le", "shift_jis", "euc_kr")}
    assert all(n >= 57 for n in right.values()), table


def test_the_chain():
    chinese = "这是正常的中文内容，用来检测。" * 5
    assert E.read(b"\xef\xbb\xbf" + chinese.encode())[:2] == (chinese, "utf-8-bom")
    assert E.read(chinese.encode("utf-16"))[:2] == (chinese, "utf-16")
    assert E.read("﻿".encode("utf-16-be") + chinese.encode("utf-16-be"))[:2] == (chinese, "utf-16")
    assert E.read("自动检测测试".encode("gbk"))[:2] == ("自动检测测试", "gb18030")
    assert E.read(b"\xd0\xcf\xc9\xfa")[1] in ("gb18030", "gb18030-forced")
    # a few bytes that fit no encoding do not spoil the text
    spoiled = chinese.encode("gbk") + b"\xff" + b" plain"
    assert E.read(spoiled)[1].startswith("gb18030") and E.read(spoiled)[0].startswith(chinese)
    assert E.read(b"plain words")[:2] == ("plain words", "utf-8-replace") and E.read(b"") == ("", "utf-8-replace", 0.0)
    assert E.read(b"valid\x00invalid\xff")[1:] == ("utf-8-replace", 0.0)
    long = ("文" * 60_000).encode()  # the sample ends within a character
    assert E.read(long)[1:] == ("utf-8", 1.0)


def test_share_on_columns(spark):
    texts = ["中文 ab", "", None, " \n\r", "㐀x" + "y" * 4000, "中" * 3000 + "a" * 100]
    df = spark.createDataFrame([(i, t, t.encode("utf-8") if t is not None else None) for i, t in enumerate(texts)], "i int, t string, b binary")
    got = df.select("i", E.cjk_share(F.col("t")).alias("s"), E.read_text("b").alias("r")).orderBy("i").collect()
    assert [r.s for r in got] == [0.5, 0.0, 0.0, 0.0, 1 / 3000, 1.0] and [r.s for r in got if r.i != 2] == [E.cjk_ratio(t) for t in texts if t is not None]
    assert got[2].r.text is None and got[5].r.encoding == "utf-8"
