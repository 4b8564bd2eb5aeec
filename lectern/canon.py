"""The canon and the names by which its books are called."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Abbreviation, English name, Korean name, three-letter code, in canonical order.
CANON = """
gn|Genesis|창세기|GEN
ex|Exodus|출애굽기|EXO
lv|Leviticus|레위기|LEV
nm|Numbers|민수기|NUM
dt|Deuteronomy|신명기|DEU
js|Joshua|여호수아|JOS
jud|Judges|사사기|JDG
rt|Ruth|룻기|RUT
1sm|1 Samuel|사무엘상|1SA
2sm|2 Samuel|사무엘하|2SA
1kgs|1 Kings|열왕기상|1KI
2kgs|2 Kings|열왕기하|2KI
1ch|1 Chronicles|역대상|1CH
2ch|2 Chronicles|역대하|2CH
ezr|Ezra|에스라|EZR
ne|Nehemiah|느헤미야|NEH
et|Esther|에스더|EST
job|Job|욥기|JOB
ps|Psalms|시편|PSA
prv|Proverbs|잠언|PRO
ec|Ecclesiastes|전도서|ECC
so|Song of Solomon|아가|SOL
is|Isaiah|이사야|ISA
jr|Jeremiah|예레미야|JER
lm|Lamentations|예레미야애가|LAM
ez|Ezekiel|에스겔|EZE
dn|Daniel|다니엘|DAN
ho|Hosea|호세아|HOS
jl|Joel|요엘|JOE
am|Amos|아모스|AMO
ob|Obadiah|오바댜|OBA
jn|Jonah|요나|JON
mi|Micah|미가|MIC
na|Nahum|나훔|NAH
hk|Habakkuk|하박국|HAB
zp|Zephaniah|스바냐|ZEP
hg|Haggai|학개|HAG
zc|Zechariah|스가랴|ZEC
ml|Malachi|말라기|MAL
mt|Matthew|마태복음|MAT
mk|Mark|마가복음|MAR
lk|Luke|누가복음|LUK
jo|John|요한복음|JOH
act|Acts|사도행전|ACT
rm|Romans|로마서|ROM
1co|1 Corinthians|고린도전서|1CO
2co|2 Corinthians|고린도후서|2CO
gl|Galatians|갈라디아서|GAL
eph|Ephesians|에베소서|EPH
ph|Philippians|빌립보서|PHI
cl|Colossians|골로새서|COL
1ts|1 Thessalonians|데살로니가전서|1TH
2ts|2 Thessalonians|데살로니가후서|2TH
1tm|1 Timothy|디모데전서|1TI
2tm|2 Timothy|디모데후서|2TI
tt|Titus|디도서|TIT
phm|Philemon|빌레몬서|PHM
hb|Hebrews|히브리서|HEB
jm|James|야고보서|JAM
1pe|1 Peter|베드로전서|1PE
2pe|2 Peter|베드로후서|2PE
1jo|1 John|요한일서|1JO
2jo|2 John|요한이서|2JO
3jo|3 John|요한삼서|3JO
jd|Jude|유다서|JUD
re|Revelation|요한계시록|REV
"""

# Further English names, then English abbreviations of each book.
ENGLISH = """
gn: gen
ex: exo ex
lv: lev lv
nm: num numb nm
dt: deu deut dt
js: josh jos jsh js
jud: judg jdg jdgs
rt: rut rt
1sm: 1sa 1sam 1sm
2sm: 2sa 2sam 2sm
1kgs: 1ki 1kgs 1kin 1kg
2kgs: 2ki 2kgs 2kin 2kg
1ch: 1ch 1chr 1chron
2ch: 2ch 2chr 2chron
ezr: ezr
ne: neh ne
et: est esth et
ps: psalm psa pss ps
prv: pro prov prv
ec: ecc eccl ec qoh
so: songofsongs songs sos sol son so
is: isa is
jr: jer jr
lm: lam lm
ez: eze ezek ez
dn: dan dn
ho: hos ho
jl: joe jl
am: amo am
ob: oba obad ob
jn: jon
mi: mic mi
na: nah
hk: hab hk
zp: zep zeph zp
hg: hag hg
zc: zec zech zc
ml: mal ml
mt: mat matt mt
mk: mar mrk mk
lk: luk lk
jo: joh jhn jn
act: actoftheapostles actsoftheapostles act
rm: rom ro rm
1co: 1co 1cor
2co: 2co 2cor
gl: gal gl
eph: eph
ph: phi phil php ph
cl: col cl
1ts: 1th 1the 1thes 1ths 1thess 1ts
2ts: 2th 2the 2thes 2ths 2thess 2ts
1tm: 1ti 1tim 1tm
2tm: 2ti 2tim 2tm
tt: tit tt
phm: phm phlm
hb: heb hb
jm: jam jas jm
1pe: 1pe 1pet
2pe: 2pe 2pet
1jo: 1jn 1jo
2jo: 2jn 2jo
3jo: 3jn 3jo
jd: jud jd
re: rev re apoc
"""

# Korean abbreviations in canonical order.
KOREAN = """
창 출 레 민 신 수 삿 룻 삼상 삼하 왕상 왕하 대상 대하 스 느 에 욥 시 잠 전 아 사 렘 애 겔 단 호 욜 암 옵 욘 미 나 합 습 학 슥 말
마 막 눅 요 행 롬 고전 고후 갈 엡 빌 골 살전 살후 딤전 딤후 딛 몬 히 약 벧전 벧후 요일 요이 요삼 유 계
"""

BOOKS = [(i, *line.split("|")) for i, line in enumerate(CANON.split("\n")[1:-1], 1)]


def _aliases() -> list[tuple[str, str]]:
    """(alias, abbreviation): names in lower case without spaces, then what is written above."""
    out = {name.lower().replace(" ", ""): abbrev for _, abbrev, name, _, _ in BOOKS}
    for line in ENGLISH.split("\n")[1:-1]:
        abbrev, _, names = line.partition(": ")
        out |= dict.fromkeys(names.split(), abbrev)
    out |= {name: book[1] for name, book in zip(KOREAN.split(), BOOKS, strict=True)}
    return [*(out | {ko: abbrev for _, abbrev, _, ko, _ in BOOKS}).items()]


ALIASES = _aliases()


def books(spark: SparkSession) -> DataFrame:
    """ord, abbrev, en, ko, code of the canon's 66 books."""
    return spark.createDataFrame(BOOKS, "ord int, abbrev string, en string, ko string, code string")


def aliases(spark: SparkSession, speech: bool = False) -> DataFrame:
    """n, alias, abbrev. In speech single syllables mean something else, so they are left out."""
    kept = [(i, a, b) for i, (a, b) in enumerate(ALIASES) if not (speech and len(a) == 1 and "가" <= a <= "힣")]
    return spark.createDataFrame(kept, "n int, alias string, abbrev string")
