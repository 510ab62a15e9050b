import pytest

pytest.importorskip("sparwood.llm")
from sparwood.llm.sentences import sentences  # noqa: E402

CASES = [
    ("Bring rope, etc. Dr. Ubakas says so. It is 1.58 mm.", ["Bring rope, etc.", "Dr. Ubakas says so.", "It is 1.58 mm."]),
    ("We left at 8:20 a.m. and met Mrs. Tuvike. eBay-style prices, 26.58, are silly!! Why?!", ["We left at 8:20 a.m. and met Mrs. Tuvike.", "eBay-style prices, 26.58, are silly!!", "Why?!"]),
    ('"Is it wet?" asked ralu. He shouted: "Stop. Not slugs!" and ran. (Nothing here, e.g. now.) Next.', ['"Is it wet?" asked ralu.', 'He shouted: "Stop. Not slugs!" and ran.', "(Nothing here, e.g. now.)", "Next."]),
    ("It was... how to put it... pale. Well… maybe.", ["It was... how to put it... pale.", "Well… maybe."]),
    ("Im 19. Jh. war hier d. h. überall Moor. Am 3. Oktober um 8.16 Uhr. Vgl. Abb. 2 bzw. S. 3.", ["Im 19. Jh. war hier d. h. überall Moor.", "Am 3. Oktober um 8.16 Uhr.", "Vgl. Abb. 2 bzw. S. 3."]),
    ("„Ei. Mitte mingil juhul!“ hüüdis Pirnak. Kohtume 3. septembril kohas nr. 146. Vt. lk. 5, seal jne. kirjas.", ["„Ei. Mitte mingil juhul!“ hüüdis Pirnak.", "Kohtume 3. septembril kohas nr. 146.", "Vt. lk. 5, seal jne. kirjas."]),
    ("«¿Sigue mojado?», preguntó ralu. ¡Qué raro! Son aprox. 6,1 km. Véase la pág. 2.", ["«¿Sigue mojado?», preguntó ralu.", "¡Qué raro!", "Son aprox. 6,1 km.", "Véase la pág. 2."]),
    ("«Там ещё сыро?» — спросил ralu. В 1987 г. здесь было болото, т. е. вода. А. К. Varlo не разрешает.", ["«Там ещё сыро?» — спросил ralu.", "В 1987 г. здесь было болото, т. е. вода.", "А. К. Varlo не разрешает."]),
    ("他喊：「停。那不是笔记！」然后跑了。“那里还湿吗？”ralu问。嗯……也许吧。真的吗？！版3.5有（共2块）。", ["他喊：「停。那不是笔记！」然后跑了。", "“那里还湿吗？”ralu问。", "嗯……也许吧。", "真的吗？！", "版3.5有（共2块）。"]),
    ("พบกันตอน 9.27 น. ที่บ่อกรวด ขอบคุณมากนะคะ เก็บได้ 144 ดอก", ["พบกันตอน 9.27 น. ที่บ่อกรวด", "ขอบคุณมากนะคะ", "เก็บได้ 144 ดอก"]),
    ('"क्या गीला है?" ralu ने पूछा। गाड़ी 2.5 कि.मी. है। डॉ. Tuvike ने।', ['"क्या गीला है?" ralu ने पूछा।', "गाड़ी 2.5 कि.मी. है।", "डॉ. Tuvike ने।"]),
    ("«هل رطب؟» سأل ralu. قال د. Wendrik إن المطر 28.2 مم. حسنا... ربما.", ["«هل رطب؟» سأل ralu.", "قال د. Wendrik إن المطر 28.2 مم.", "حسنا... ربما."]),
    ("ralu wrote:\n> One line is\n> wrapped here. Two.\n>\n> - An item. Whole\n> goes on.\n>> Deeper\n\nbump\n\n1) A.\n2) B\n-----\nEnd\n-- \nralu, plot 6\nNever eat. Ever.", ["ralu wrote:", "One line is\n> wrapped here.", "Two.", "- An item. Whole\n> goes on.", "Deeper", "bump", "1) A.", "2) B", "End", "ralu, plot 6", "Never eat. Ever."]),
    ("<p>One.<br>Two &quot;x.&quot; y.</p><p>[quote=ralu]Three <b>four</b>.[/quote]\n* * *\nfive</p>", ["One.", "Two &quot;x.&quot; y.", "Three <b>four</b>.", "five"]),
    ("A\r\n\r\nBe. C\rD", ["A", "Be.", "C\rD"]),
    ("👩‍🌾 x1 lol. 🍄", ["👩‍🌾 x1 lol."]),
    (" own. Next.", ["own.", "Next."]),
    ("", []), (None, []), (" \n> \n---", []),
]


def test_sentences_of_all_kinds(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, (t, _) in enumerate(CASES)], "doc_id bigint, text string, _i string, sent_no int")
    got: dict = {}
    for r in sentences(df, "doc_id", "text").orderBy("doc_id", "sent_no").collect():
        got.setdefault(r.doc_id, []).append((r.sent_no, CASES[r.doc_id][0][r.start_pos : r.end_pos]))
    for i, (text, want) in enumerate(CASES):
        assert got.get(i, []) == list(enumerate(want, 1)), text


def test_repeated_rows_and_long_texts(spark):
    long = "Word after word. " * 20000
    df = spark.createDataFrame([(1, "A b. C d."), (1, "A b. C d."), (2, long)], "doc_id bigint, text string")
    rows = sentences(df, "doc_id", "text").collect()
    assert sorted(r.sent_no for r in rows if r.doc_id == 1) == [1, 1, 2, 2]
    assert max(r.end_pos for r in rows if r.doc_id == 2) == len(long) - 1 and sum(r.doc_id == 2 for r in rows) == 20000
