"""License scans, quality rules, decontamination and personal data against plain-Python versions of their rules."""

import base64
import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import public_tokenizers
import pytest
from cases import alnum, no_documents, odd_documents, odd_rows, prose
from sentencepiece import SentencePieceProcessor

from keysift.llm import contamination, fertility, licenses, pii, queries

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path(queries.PIECES)


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# Licenses

def plain_licenses(text):
    words = alnum(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def license_columns(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_license_base_of_odd_rows_and_query(spark):
    texts = ["The MIT License, mit license", "mit x license", "Apache Licence", "GNU General Public License general public license", "mit license" * 3]
    docs = [(100 + i, t) for i, t in enumerate(texts)] + [(i, t) for i, t, *_ in odd_rows()]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'own' as labels", "1 as score"))
    assert Counter((r.doc_id, *license_columns(r)) for r in got.collect()) == Counter((i, *plain_licenses(t)) for i, t in docs)
    assert licenses.scan(no_documents(spark)).count() == 0
    assert licenses.scan(odd_documents(spark)).count() == len(odd_rows())
    docs = read(spark, "documents").select("doc_id", "text").collect()
    found = queries.op3_licenses(spark, SF).collect()
    assert {r.doc_id: license_columns(r) for r in found} == {d: plain_licenses(t) for d, t in docs}
    for r in found:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_templates_need_words_in_place_and_a_key_phrase(spark):
    grant = licenses.TEMPLATES[0][1]
    words = grant.split()
    changed = " ".join("x" if i % 9 == 8 else w for i, w in enumerate(words))
    shuffled = words[:]
    random.Random(1).shuffle(shuffled)
    texts = [
        prose(30) + " " + grant.upper() + " " + prose(30), prose(5) + " " + changed, " ".join(shuffled), grant.replace("charge", "fee"),
        "licensed under CC BY-NC 4.0.", "released under CC BY-SA 4.0", "nothing here",
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(7)] == ["mit", "mit", "", "", "cc-by-nc", "cc-by-sa", ""]
    assert got[0].score == 1.0 and 0.7 <= got[1].score < 1 and got[6].score == 0.0
    assert got[0].found[0].start == 30


def test_all_templates_in_one_text_are_found(spark):
    """A text that holds every template, with common license words between them, has the places and labels of each."""
    notice = prose(3).join(f" {text} " for _, text, _ in licenses.TEMPLATES)
    texts = [notice, " ".join(text for _, text, _ in reversed(licenses.TEMPLATES)), notice + " the software is of the license to " * 500 + notice, "by sa 4 0 cc by sa 4 0"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        words, wanted = alnum(text), set()
        for label, template, keys in licenses.TEMPLATES:
            own = template.split()
            for start in range(-len(own), len(words)):
                part = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(own)) / len(own)
                near = words[max(start - licenses.SLACK, 0) : max(start + len(own) + licenses.SLACK, 0)]
                if part >= licenses.LEAST_PART and any(f" {key} " in f" {' '.join(near)} " for key in keys):
                    wanted.add((label, start, part))
        wanted |= {(label, k, 1.0) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()}
        assert [(f.label, f.start, f.part) for f in got[i].found] == sorted(wanted)
    every = ",".join(sorted({label for label, *_ in licenses.TEMPLATES}))
    assert [got[i].labels for i in range(3)] == [every] * 3 and got[0].score == 1.0


# Quality rules

def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    counts = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)
    return (*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def quality_columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def plain_fertility(text, model):
    ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", text) for i in model.encode(w)]
    counts = Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())
    return len(ids), sum(model.is_byte(i) for i in ids) / len(ids), entropy / math.log2(min(len(ids), model.get_piece_size()))


def test_quality_of_odd_rows_and_query(spark):
    got = fertility.quality(odd_documents(spark), PIECES).collect()
    assert Counter((r.doc_id, *quality_columns(r)) for r in got) == Counter((i, *plain_counts(t)) for i, t, *_ in odd_rows())
    assert fertility.quality(no_documents(spark), PIECES).count() == 0
    docs = dict(map(tuple, read(spark, "documents").select("doc_id", "text").collect()))
    model = SentencePieceProcessor(model_file=PIECES)
    for r in queries.op5_fertility(spark, SF).collect():
        assert quality_columns(r) == plain_counts(docs[r.doc_id])
        n_tokens, share, entropy = plain_fertility(docs[r.doc_id], model)
        assert r.n_tokens == n_tokens and r.byte_share == pytest.approx(share) and r.entropy_part == pytest.approx(entropy)
        assert r.chars_per_token == pytest.approx(r.word_chars / n_tokens)
        least, most, byte_share, part = fertility.BANDS[r.script]
        fits = least <= r.chars_per_token <= most and share <= byte_share and entropy >= part
        assert r.kept == (fits and not r.base_failed)


def test_repeated_words_with_many_numbers():
    import numpy as np

    assert fertility.repeated_words(np.array([0, 1, 2, 0, 1, 2, 9])) == 6
    assert fertility.repeated_words(np.array([0, 1, 2, 0, 1, 2, 9]) * (1 << 25)) == 6
    assert fertility.repeated_words(np.array([4, 4, 4, 4])) == 4 and fertility.repeated_words(np.array([4, 4])) == 0


def test_fertility_bands_reject_by_script(spark):
    greek, junk = " ".join("λόγος άνθρωπος θάλασσα ουρανός".split() * 20), " ".join(f"⿠{chr(0x2A00 + i)}{chr(0x2E00 + i % 90)}" for i in range(60))
    texts = [prose(200), " ".join(f"aa{i % 2}" for i in range(100)), greek, junk]
    got = {r.doc_id: r for r in fertility.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES).collect()}
    assert [got[i].script for i in range(4)] == ["latin", "latin", "greek", "other"]
    assert got[0].kept and not got[1].kept and got[3].byte_share > 0.5
    strict = fertility.BANDS | {"latin": (50.0, 60.0, 0.0, 1.0)}
    assert not any(r.kept for r in fertility.quality(spark.createDataFrame([(0, prose(200))], "doc_id long, text string"), PIECES, strict).collect())


# Clean prose of languages that the vocabulary serves worst.
CLEAN = {
    "ka": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით. ბავშვები ყოველ დილით სკოლაში მიდიან, სწავლობენ კითხვას და წერას, შემდეგ კი სახლში ბრუნდებიან.",
    "hy": "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ և իրավունքներով։ Նրանք ունեն բանականություն ու խիղճ և միմյանց պետք է եղբայրաբար վերաբերվեն։ Երեխաները ամեն առավոտ դպրոց են գնում, սովորում են կարդալ և գրել, հետո վերադառնում են տուն։",
    "km": "មនុស្ស ទាំងអស់ កើត មក មាន សេរីភាព និង សមភាព ក្នុង សេចក្ដី ថ្លៃថ្នូរ និង សិទ្ធិ ។ មនុស្ស មាន វិចារណញ្ញាណ និង សតិសម្បជញ្ញៈ ហើយ គប្បី ប្រព្រឹត្ត ចំពោះ គ្នា ទៅ វិញ ទៅ មក ដោយ ស្មារតី ភាតរភាព ។ កុមារ ទៅ សាលា រៀន រាល់ ព្រឹក ។",
    "my": "လူတိုင်းသည် တူညီ လွတ်လပ်သော ဂုဏ်သိက္ခာဖြင့် လည်းကောင်း၊ တူညီလွတ်လပ်သော အခွင့်အရေးများဖြင့် လည်းကောင်း၊ မွေးဖွားလာသူများ ဖြစ်သည်။ ထိုသူတို့၌ ပိုင်းခြား ဝေဖန်တတ်သော ဉာဏ်နှင့် ကျင့်ဝတ် သိတတ်သော စိတ်တို့ရှိကြ၍ ထိုသူတို့သည် အချင်းချင်း မေတ္တာထား၍ ဆက်ဆံကျင့်သုံးသင့်၏။",
    "am": "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው። የተፈጥሮ ማስተዋልና ሕሊና ስላለው አንዱ ሌላውን በወንድማማችነት መንፈስ መመልከት ይገባዋል። ልጆች በየቀኑ ጠዋት ወደ ትምህርት ቤት ይሄዳሉ ማንበብና መጻፍ ይማራሉ ከዚያም ወደ ቤት ይመለሳሉ።",
    "lo": "ມະນຸດ ເກີດມາ ມີສິດ ເສລີພາບ ແລະ ສະເໝີໜ້າກັນ ໃນທາງ ກຽດຕິສັກ ແລະ ທາງສິດ ດ້ວຍ ມະນຸດ ມີສະຕິ ສຳປັດຊັນຍະ ແລະ ມີມະໂນທຳ ຈຶ່ງຕ້ອງ ປະພຶດຕົນ ຕໍ່ກັນ ໃນທາງ ພີ່ນ້ອງ ເດັກນ້ອຍ ໄປໂຮງຮຽນ ທຸກໆເຊົ້າ",
    "yo": "Gbogbo ènìyàn ni a bí ní òmìnira; iyì àti ẹ̀tọ́ kọ̀ọ̀kan sì dọ́gba. Wọ́n ní ẹ̀bùn ti làákàyè àti ti ẹ̀rí-ọkàn, ó sì yẹ kí wọn ó máa hùwà sí ara wọn gẹ́gẹ́ bí ọmọ ìyá. Ẹnì kọ̀ọ̀kan ló ní ànfàní sí gbogbo ẹ̀tọ́ àti òmìnira tí a ti gbé kalẹ̀ nínú ìkéde yìí láìfi ti ọ̀rọ̀ ìyàtọ̀ ẹ̀yà kankan ṣe. Àwọn ọmọ ilé-ìwé máa ń kọ́ bí a ṣe ń ka ìwé ní òwúrọ̀, wọ́n sì máa ń ṣeré ní ìrọ̀lẹ́.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. Mỗi buổi sáng bà tôi thường dậy sớm, pha một ấm trà nóng rồi ngồi trước hiên nhà nghe tiếng chim hót. Những đứa trẻ trong xóm chạy qua con đường nhỏ để đến trường trước khi trời mưa.",
}


def test_clean_documents_of_every_script_are_kept(spark):
    """Letters of unlisted scripts outvote an address in ASCII; Latin with many marks, composed or not, is not junk."""
    few, latin = ["ka", "hy", "km", "my", "am", "lo"], ["yo", "vi"]
    cases = [(k, "other", f"{CLEAN[k]} {mixed(CLEAN[k])} https://example.org/x") for k in few]
    cases += [(k, "latin", unicodedata.normalize(form, f"{CLEAN[k]} {mixed(CLEAN[k])}")) for k in latin for form in ("NFC", "NFD")]
    cases += [("signs", "latin", prose(60) + " → … № ½ ∑ " * 5 + "\u0301" * 500), ("none", "other", "١٢ 34 × ÷ →"), ("ascii", "latin", f"{prose(100)} {CLEAN['ka'][:40]}")]
    docs = spark.createDataFrame([(i, text) for i, (_, _, text) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in fertility.quality(docs, PIECES).collect()}
    for i, (name, script, _) in enumerate(cases):
        assert got[i].script == script, name
        least, most, byte_share, part = fertility.BANDS[script]
        if name in CLEAN:
            assert least <= got[i].chars_per_token <= most and got[i].byte_share <= byte_share and got[i].entropy_part >= part, name
            assert got[i].kept or got[i].base_failed, name
    assert {cases[i][0] for i in got if got[i].kept} >= set(CLEAN)


def mixed(text):
    """The text's words in another order, so that a document is long enough."""
    words = text.split() * 2
    random.Random(4).shuffle(words)
    return " ".join(words)


# More clean prose: scripts that the vocabularies cover, languages near the bounds of their bands, text full of figures or Markdown.
PLAIN = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Every morning the children walk to school, learn to read and write, and come home in the afternoon when the rain has stopped.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Joka aamu lapset menevät kouluun, oppivat lukemaan ja kirjoittamaan ja palaavat sitten kotiin.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Každé ráno chodí děti do školy a učí se číst a psát.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε πρωί τα παιδιά πηγαίνουν στο σχολείο και μαθαίνουν να διαβάζουν.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждое утро дети идут в школу, учатся читать и писать, а потом возвращаются домой.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. בכל בוקר הילדים הולכים לבית הספר, לומדים לקרוא ולכתוב וחוזרים הביתה.",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق، وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. يذهب الأطفال كل صباح إلى المدرسة ويتعلمون القراءة والكتابة ثم يعودون إلى البيت.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। बच्चे हर सुबह स्कूल जाते हैं, पढ़ना और लिखना सीखते हैं।",
    "bn": "সমস্ত মানুষ স্বাধীনভাবে সমান মর্যাদা এবং অধিকার নিয়ে জন্মগ্রহণ করে। তাঁদের বিবেক এবং বুদ্ধি আছে; সুতরাং সকলেরই একে অপরের প্রতি ভ্রাতৃত্বসুলভ মনোভাব নিয়ে আচরণ করা উচিত।",
    "ta": "மனிதப் பிறவியினர் சகலரும் சுதந்திரமாகவே பிறக்கின்றனர்; அவர்கள் மதிப்பிலும், உரிமைகளிலும் சமமானவர்கள், அவர்கள் நியாயத்தையும் மனச்சாட்சியையும் இயற்பண்பாகப் பெற்றவர்கள். அவர்கள் ஒருவருடனொருவர் சகோதர உணர்வுப் பாங்கில் நடந்துகொள்ளல் வேண்டும்.",
    "te": "ప్రతిపత్తిస్వత్వముల విషయమున మానవులెల్లరును జన్మతః స్వతంత్రులును సమానులును నగుదురు. వారు వివేదన-అంతఃకరణ సంపన్నులగుటచే పరస్పరము భ్రాతృభావముతో వర్తింపవలయును.",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ เด็กๆ ไปโรงเรียนทุกเช้า เรียนอ่านและเขียน แล้วกลับบ้าน",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 아이들은 매일 아침 학교에 가서 읽고 쓰는 것을 배운다.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。子供たちは毎朝学校へ行き、読み書きを学びます。",
    "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。孩子们每天早上去学校学习读书写字,下午回家帮助父母做饭,晚上一起听爷爷讲过去的故事。",
    "so": "Aadanaha dhammaantiis wuxuu dhashaa isagoo xor ah kana siman xagga sharafta iyo xuquuqda. Waxaa Alle siiyay aqoon iyo wacyi, waana in qof la arkaa qofka kale ula dhaqmaa si walaaltinimo ah.",
    "cy": "Genir pawb yn rhydd ac yn gydradd â'i gilydd mewn urddas a hawliau. Fe'u cynysgaeddir â rheswm a chydwybod, a dylai pawb ymddwyn y naill at y llall mewn ysbryd cymodlon.",
    "fon": "Gbɛtɔ́ bǐ wɛ nɔ jì mɛɖésúsínɔ bo nɔ ɖò wɛ̌ ɖokpó mɛ ɖò gǎn kpo acɛ kpo linu. Ye ɖó linkpɔ́n kpo ayi kpo bɔ ye ka ɖó na nɔ hwɛn yeɖée kpɔ́n ɖi nɔví nɔví.",
    "polyt": "Μῆνιν ἄειδε θεὰ Πηληϊάδεω Ἀχιλῆος οὐλομένην, ἣ μυρί᾽ Ἀχαιοῖς ἄλγε᾽ ἔθηκε, πολλὰς δ᾽ ἰφθίμους ψυχὰς Ἄϊδι προΐαψεν ἡρώων, αὐτοὺς δὲ ἑλώρια τεῦχε κύνεσσιν οἰωνοῖσί τε πᾶσι, Διὸς δ᾽ ἐτελείετο βουλή.",
    "mn": "Хүн бүр төрж мэндлэхэд эрх чөлөөтэй, адилхан нэр төртэй, ижил эрхтэй байдаг. Оюун ухаан, нандин чанар заяасан хүн гэгч өөр хоорондоо ахан дүүгийн үзэл санаагаар харьцах учиртай.",
    "niq": "בְּרֵאשִׁית בָּרָא אֱלֹהִים אֵת הַשָּׁמַיִם וְאֵת הָאָרֶץ וְהָאָרֶץ הָיְתָה תֹהוּ וָבֹהוּ וְחֹשֶׁךְ עַל פְּנֵי תְהוֹם וְרוּחַ אֱלֹהִים מְרַחֶפֶת עַל פְּנֵי הַמָּיִם וַיֹּאמֶר אֱלֹהִים יְהִי אוֹר וַיְהִי אוֹר",
    "ug": "ھەممە ئادەم زاتىدىنلا ئەركىن، ئىززەت-ھۆرمەت ۋە ھوقۇقتا باپباراۋەر بولۇپ تۇغۇلغان. ئۇلار ئەقىلگە ۋە ۋىجدانغا ئىگە ھەمدە بىر-بىرىگە قېرىنداشلىق مۇناسىۋىتىگە خاس روھ بىلەن مۇئامىلە قىلىشى كېرەك.",
    "kn": "ಎಲ್ಲಾ ಮಾನವರೂ ಸ್ವತಂತ್ರರಾಗಿಯೇ ಜನಿಸಿದ್ಧಾರೆ. ಹಾಗೂ ಘನತೆ ಮತ್ತು ಹಕ್ಕುಗಳಲ್ಲಿ ಸಮಾನರಾಗಿದ್ದಾರೆ. ವಿವೇಕ ಮತ್ತು ಅಂತಃಕರಣಗಳನ್ನು ಪಡೆದವರಾದ್ದರಿಂದ ಅವರು ಪರಸ್ಪರ ಸಹೋದರ ಭಾವದಿಂದ ವರ್ತಿಸಬೇಕು.",
    "or": "ସମସ୍ତ ମଣିଷ ଜନ୍ମଗତ ଭାବେ ସ୍ୱାଧୀନ ଏବଂ ସମାନ ମର୍ଯ୍ୟାଦା ଓ ଅଧିକାର ପ୍ରାପ୍ତ ଅଟନ୍ତି। ସେମାନଙ୍କୠବୁଦ୍ଧି ଓ ବିବେକ ମିଳିଛି ଏବଂ ପରସ୍ପର ପ୍ରତି ଭାତୃଭାବ ରଖିବା ଉଚିତ।",
    "ko2": "옛날 어느 마을에 콩쥐와 팥쥐라는 두 자매가 살았습니다. 콩쥐는 마음씨가 착하고 부지런했지만 팥쥐는 게으르고 욕심이 많았습니다. 닭과 꿩이 뜰에서 놀고 있었습니다.",
    "ja_lit": "メロスは激怒した。必ず、かの邪智暴虐の王を除かなければならぬと決意した。メロスには政治がわからぬ。メロスは、村の牧人である。笛を吹き、羊と遊んで暮して来た。",
    "lzh": "子曰學而時習之不亦說乎有朋自遠方來不亦樂乎人不知而不慍不亦君子乎 有子曰其為人也孝弟而好犯上者鮮矣不好犯上而好作亂者未之有也",
    "num": "The company sold 1,204 units in 2019, 1,350 in 2020 and 1,502 in 2021, while its costs rose from $12.4 million to $13.9 million (12.1%). In the first quarter, sales were 5.2% above plan.",
    "md": "# Title\n\nSome **bold** text with a [link](https://example.org/a) and `code`. \n\n* first item of the list\n* second item of the list\n\n## Next part\n\nMore plain text follows here, as one would write it in a readme file, with an R&D note.",
}


def soup(draw, letters, words=120):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(3, 10))) for _ in range(words))


def letters_of(*spans):
    return [chr(c) for a, b in spans for c in range(a, b) if unicodedata.category(chr(c))[0] in "LM"]


def junk():
    """Texts that are no prose although the plain counts may pass them, by name."""
    draw = random.Random(7)
    lower = "abcdefghijklmnopqrstuvwxyz"
    out = {
        "base64": " ".join(base64.b64encode(draw.randbytes(48)).decode() for _ in range(60)), "hex": " ".join(draw.randbytes(20).hex() for _ in range(60)),
        "letters": soup(draw, lower), "mixed": soup(draw, lower + lower.upper() + "0123456789"), "digits": soup(draw, "0123456789"),
        "escapes": " ".join("%D0%BB%D1%8E" + soup(draw, "0123456789ABCDEF", 2).replace(" ", "%") for _ in range(60)),
        "signs": " ".join(f"{w}{draw.choice(['***', '###', '&&&', '%%%'])}" for w in prose(200).split()),
        "bars": " ".join(w + " |" * (i % 2) for i, w in enumerate(prose(200, 5).split())),
        "glyphs": " ".join(f"⿠{chr(0x2A00 + i)}{chr(0x2E00 + i % 90)}" for i in range(60)),
    }
    for name in ("ru", "ar", "zh", "hi", "ja", "ko", "th", "el", "he"):
        out[f"{name} read as Latin"] = f"{PLAIN[name]} {mixed(PLAIN[name])}".encode().decode("latin-1")
    spans = {
        "latin": (0xC0, 0x250), "greek": (0x370, 0x400), "cyrillic": (0x400, 0x530), "hebrew": (0x591, 0x5F3), "arabic": (0x600, 0x700), "devanagari": (0x900, 0x980),
        "bengali": (0x980, 0xA00), "tamil": (0xB80, 0xC00), "telugu": (0xC00, 0xC80), "kannada": (0xC80, 0xD00), "thai": (0xE01, 0xE5C), "hangul": (0xAC00, 0xD7A4),
        "kana": (0x3041, 0x30FF), "han": (0x4E00, 0x9FFF),
    }
    return out | {f"random {name}": soup(draw, letters_of(span)) for name, span in spans.items()}


def measured(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for _, r in sorted((r.doc_id, r) for r in fertility.quality(docs, PIECES).collect())]


def test_bands_reject_junk_of_every_script(spark):
    texts = junk()
    for name, r in zip(texts, measured(spark, texts.values())):
        assert not r.kept, name
        if name.endswith("read as Latin"):
            assert r.chars_per_rank_token < fertility.RANK_BANDS["latin"][0] or r.letter_share < fertility.LEAST_LETTERS, name
        else:
            assert not r.base_failed, name


def test_bands_keep_prose_of_every_script(spark):
    """Clean prose, composed or not, is inside both vocabularies' bands, whatever its number of words."""
    clean = [(k, unicodedata.normalize(form, f"{t} {mixed(t)} {mixed(mixed(t))}")) for k, t in (CLEAN | PLAIN).items() for form in ("NFC", "NFD")]
    got = measured(spark, [t for _, t in clean])
    for (name, _), r in zip(clean, got):
        least, most, byte_share, part = fertility.BANDS[r.script]
        assert least <= r.chars_per_token <= most and r.byte_share <= byte_share and r.entropy_part >= part, name
        assert r.sign_share <= fertility.MOST_SIGNS and r.letter_share >= fertility.LEAST_LETTERS, name
        assert r.kept or r.base_failed, name
    assert sum(r.kept for r in got) > 40


def test_long_runs_do_not_stop_the_second_tokenizer(spark):
    texts = [prose(60) + unit * 1_500_000 + "x" for unit in ("\u00a0", "\u3000", "x", "!", "\u0301")]
    got = measured(spark, texts)
    assert [r.n_words for r in got] == [60] * 5 and not any(r.kept for r in got)
    assert got[0].n_rank_tokens == got[1].n_rank_tokens <= got[2].n_rank_tokens // 100


def test_verdict_agrees_with_labels_and_second_tokenizer(spark):
    """Of the texts that the plain counts pass, those labelled as bad are rejected and those labelled as good stay."""
    import tiktoken

    folder = "/root/testdata/sf0.01"
    with open(fertility.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(map(tuple, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()))
    good = dict(map(tuple, spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()))
    rows = queries.op5_fertility(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows[::7]:
        assert r.n_rank_tokens == sum(len(encoding.encode_ordinary(" " + w)) for w in re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
    verdicts = Counter((good[r.doc_id], r.kept) for r in rows if not r.base_failed and r.doc_id in good)
    assert verdicts[0, False] > 0 and verdicts[1, True] > 0 and verdicts[0, True] == verdicts[1, False] == 0


def test_filtered_returns_all_columns(spark):
    docs = odd_documents(spark)
    kept = fertility.filtered(docs, PIECES)
    assert kept.schema.names == docs.schema.names
    wanted = Counter(r.doc_id for r in fertility.quality(docs, PIECES).collect() if r.kept)
    assert Counter(r.doc_id for r in kept.collect()) == wanted and wanted


# Decontamination

def plain_matches(docs, items, window=13):
    windows = {}
    for item, text in items:
        words = alnum(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc_id, text in docs:
        words, hit, found = alnum(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (own := windows.get(tuple(words[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found.update(str(x) for x in own if x is not None)
        listed = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), listed, bool(hit) and 20 * len(hit) >= len(words)))
    return Counter(out)


def columns(found):
    return Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), r.items_sha256, r.contaminated) for r in found.collect())


def planted(seed=3):
    items = [(1, prose(30, 11)), (2, prose(13, 12)), (10, "only four words here"), (3, None), (4, ""), (None, prose(20, 13)), (2, prose(15, 14)), (5, prose(25, 11))]
    body = prose(60, 20)
    docs = [(i, t) for i, t, *_ in odd_rows()] + [
        (50, body + " " + prose(30, 11) + " " + body), (51, prose(12, 11)), (52, prose(13, 11)), (53, "Only FOUR words, here!"), (54, prose(20, 13)),
        (55, prose(900, 21) + " " + prose(15, 14)), (56, prose(13, 12) * 2), (57, " ".join(alnum(prose(30, 11))[5:25])),
    ]
    return docs, items


@pytest.mark.parametrize("block_bytes", [contamination.BLOCK_BYTES, 60])
def test_matches_of_planted_passages(spark, monkeypatch, block_bytes):
    """One block of items, and many, give the same."""
    monkeypatch.setattr(contamination.item_blocks, "__defaults__", (block_bytes,))
    docs, items = planted()
    tables = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as marks", "1 as items", "2 as longest"), spark.createDataFrame(items, "item_id long, text string")
    assert columns(contamination.matches(*tables)) == plain_matches(docs, items)
    kept = contamination.decontaminate(*tables)
    assert kept.schema.names == tables[0].schema.names
    clean = Counter()
    for (d, *_, bad), n in plain_matches(docs, items).items():
        clean[d] += n * (not bad)
    assert Counter(r.doc_id for r in kept.collect()) == +clean


def test_matches_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination.matches(no_documents(spark), items).count() == 0
    assert all(not r.contaminated and r.n_hit == 0 for r in contamination.matches(odd_documents(spark), items).collect())


def test_longest_match_and_spans(spark):
    docs, items = [(1, "a b " + prose(30, 11) + " c d"), (2, prose(20, 11))], [(7, prose(30, 11))]
    got = {r.doc_id: r for r in contamination.matches(*(spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id")))).collect()}
    assert got[1].longest == 30 and [(s.start, s.end) for s in got[1].spans] == [(2, 32)] and got[2].longest == 20


def test_contamination_query_equals_plain(spark):
    docs = [tuple(r) for r in read(spark, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read(spark, "benchmark").select("item_id", "text").collect()]
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op8_suffix_matches(spark, SF).collect())
    assert got == plain_matches(docs, items)


# Personal data

def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out, text = [], text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def assert_rules(got, docs):
    want = Counter()
    for i, t in docs:
        spans = plain_spans(t)
        kinds = Counter(k for k, *_ in spans)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[(i, *(kinds[k] for k in pii.KINDS[:-1]), hashlib.sha256(listed.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    by_id = dict(docs)
    for r in got:
        assert [s for s in r.spans.split(",") if s and not s.startswith("id:")] == [f"{k}:{a}:{b}" for k, a, b in plain_spans(by_id[r.doc_id])]


ALPHABET = [
    "a", "b@", "c.", "1", "23", ".", "4.5", " ", "+", "+1 ", "(555)", "-", "@", "x@y.z", "_", "%", "é", "😀", "10.0.0.1", "4041894974608795", "0", "256", "\n", "d@e",
    "..", "4111 1111-1111 1111", "12345678901234567890", "000255.1.1.1", "password=a1b2c3d4",
]


def test_rules_on_random_texts(spark):
    draw = random.Random(9)
    docs = [(1000 + i, "".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 25)))) for i in range(800)]
    docs += [(1, "9" * 20000 + " 1" * 20000 + "1.2" * 5000), (2, "a@b.c" * 3000)] + [(i + 5000, t) for i, t, *_ in odd_rows() if i is not None]
    assert_rules(pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_personal_data_of_odd_rows_and_query(spark):
    assert pii.personal_data(odd_documents(spark)).count() == len(odd_rows())
    assert pii.personal_data(no_documents(spark)).count() == 0
    assert_rules(queries.op6_personal_data(spark, SF).collect(), [tuple(r) for r in read(spark, "documents").select("doc_id", "text").collect()])


def test_contexts_of_seeds_give_away_unseen_forms(spark):
    """Hexadecimal seeds make ``account ref`` a strong context, which gives away values that are no seeds; ``page`` stays weak."""
    docs = [(i, f"{prose(5, i)} account ref {hashlib.md5(str(i).encode()).hexdigest()} page {i} and 10.0.0.{i} ok") for i in range(40)]
    docs += [(100, "my account ref QX-77b1-Z, done"), (101, "see page 777777 please"), (102, "account ref none")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[100].spans == "id:15:24" and got[101].spans == "" and got[102].spans == ""
    assert all(got[i].n_id == 1 and got[i].n_ip == 1 for i in range(40))


def test_whole_rule_matches_are_seeds(spark):
    """Emails without a digit, and phones and cards written with spaces, make their contexts strong; each is one seed."""
    names = [f"{a}{b}.{c}" for a in ("jan", "ol", "per") for b in ("e", "af", "o") for c in ("doe", "roe")]
    docs = [(i, f"please write to {name}@example.org now") for i, name in enumerate(names)]
    docs += [(100 + i, f"or call me +44 20 7946 0{i}58 soon") for i in range(100, 120)]
    docs += [(300 + i, f'mail="{name}@example.org" sent') for i, name in enumerate(names)]
    docs += [(400 + i, f"paid by 4111 1111 1111 {n} today") for i, n in enumerate(n for n in range(1000, 1200) if luhn(f"411111111111{n}"))]
    docs += [(500 + i, f"the same one +44 20 7946 0958 again {i}") for i in range(20)]
    docs += [(900, "write to QX-77b1-Z now"), (901, "call me QX-77b1-Z"), (902, 'mail="QX-77b1-Z"'), (903, "paid by QX-77b1-Z"), (904, "same one QX-77b1-Z"), (905, "page no QX-77b1-Y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(frame).collect()}
    assert [got[i].spans for i in range(900, 906)] == ["id:9:18", "id:8:17", "id:6:15", "id:8:17", "", ""]
    scanned = pii._scanned(frame, "doc_id")
    scores = {r.context: r for r in pii.score_contexts(pii._tokens(scanned, pii._rule_spans(scanned))).collect()}
    assert [scores[c].support for c in ("write to", "call me", "mail=", "paid by", "same one")] == [18, 20, 18, 20, 1]
    assert "" not in scores and not any("7946" in c or "+" in c for c in scores)


def test_redaction_replaces_spans_only(spark):
    docs = odd_documents(spark)
    clean = pii.redacted(docs)
    assert clean.schema.names == docs.schema.names
    rows = clean.collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in odd_rows())
    by_id = {r.doc_id: r.text for r in rows if r.doc_id not in (None, 3)}
    assert by_id[0] is None and by_id[15] == "mail <EMAIL> or <PHONE>, <IP>"
    assert all(by_id[i] == t for i, t, *_ in odd_rows() if i in by_id and i != 15 and not plain_spans(t) and i != 12)
    assert pii.redacted(no_documents(spark)).count() == 0


def test_main_path_runs_no_python(spark):
    plan = pii.personal_data(read(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
