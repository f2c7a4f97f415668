"""Product names: clean forms, letters of Hangul, similarity, and the ordered rules that read a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import compact, let, similarity

#: Origins that stand in product names.
ORIGINS = ("국내산", "국내", "미국산", "수입산", "수입", "호주산", "캐나다산", "브라질산", "덴마크산", "스페인산", "칠레산", "네덜란드산", "멕시코산")
#: Misread words and what they stand for, in the order in which they are replaced.
MISREADS = (("넥장|넹장|냉쟝", "냉장"), ("넥동|넹동|냉돔", "냉동"))
SUBSTITUTIONS = (*MISREADS, ("황창|항창|황정살?|항졍", "항정"), ("삼겸", "삼겹"), ("삼겹쌀|삼겹삽", "삼겹살"), ("(?<!소|우)목심", "목살"), ("부체살", "부채살"), ("채끝살", "채끝"))
#: Pattern, cut, category and qualifier; the first pattern that a name has decides.
CUTS = (
    ("우삼겹살?|소삼겹살?", "우삼겹", "소고기", ""), ("우목심|우목살|소목심|소목살", "목심", "소고기", ""), ("차돌박이", "차돌박이", "소고기", ""), ("도가니", "도가니", "소고기", ""),
    ("부채살", "부채살", "소고기", ""), ("채끝", "채끝", "소고기", ""), ("안심", "안심", "소고기", ""), ("등심", "등심", "소고기", ""), ("사태", "사태", "소고기", ""),
    ("등뼈", "등뼈", "돼지고기", ""), ("등갈비", "등갈비", "돼지고기", ""), ("쪽갈비", "쪽갈비", "돼지고기", ""), ("돼지갈비|돈갈비", "갈비", "돼지고기", ""), ("갈비", "갈비", "소고기", ""),
    ("우족", "우족", "소고기", ""), ("사골", "사골", "소고기", ""), ("스지", "스지", "소고기", ""), (r"미박\s*삼겹", "삼겹", "돼지고기", "미박"), ("오겹", "삼겹", "돼지고기", "미박"),
    (r"미박\s*앞다리살?", "앞다리살", "돼지고기", "미박"), (r"미박\s*뒷다리살?", "뒷다리", "돼지고기", "미박"), ("이겹살?", "이겹살", "돼지고기", ""), ("삼겹", "삼겹", "돼지고기", ""),
    ("목살", "목살", "돼지고기", ""), ("항정", "항정", "돼지고기", ""), ("가브리살|가브릿살|가브리살살", "가브리살", "돼지고기", ""), ("갈매기살?", "갈매기살", "돼지고기", ""),
    ("앞다리", "앞다리", "돼지고기", ""), ("뒷다리", "뒷다리", "돼지고기", ""), ("볼살|뽈살", "볼살", "돼지고기", ""), ("닭가슴살|계육가슴살", "가슴살", "닭고기", ""), ("닭다리살|계육다리살", "다리살", "닭고기", ""),
)
#: Standard names and the patterns that stand for them between blanks or brackets, in the order in which they are replaced.
ALIASES = (
    ("오겹살", r"오겹살?|(?:미빅피|미박피|미밖피|미뱍피|미박|미빅|미밖|미백|미뱍|미)\s*(?:삼겹살?|삼겹쌀|삽겹살?)"),
    ("미박 앞다리살", r"미전지|미젼지|미전쥐|미전디|이전지|(?:미박|미밖)\s*전지|미\s*(?:앞다리|압다리|앞다라)살|(?:미박|미밖)\s*(?:앞다리|압다리|앞다라)살?|(?:앞다리|압다리|앞다라)살?\s*(?:미박|미밖)"),
    ("미박 뒷다리살", r"미후지|미\s*후지|미박\s*후지|미\s*뒷다리살?|미박\s*뒷다리살?"), ("이겹살", "이겹살?"), ("가브리살", "등심덧살|가브리|가브리살|가브릿살|가브리쌀|가브리삽|가브리샬|가브라살|가부리|가부리살|가비리살|까브리살"),
    ("돼지 갈비", r"(?:돼지\s*갈비살?|돈\s*갈비살?)"), ("삼겹살", r"(?:박피|박펴|박파|박비|빅피|밖피)\s*(?:삼겹살?|삼겹쌀|삽겹살?)"),
)
#: Typing errors of skin-on cuts and what they mean, in the order in which they are replaced.
CUT_WORDS = r"(?:삼겹|앞다리|압다리|앞다라|전지|뒷다리|후지)(?:살)?(?=$|[\s()])"
TYPOS = ((r"(^|[\s(])(?:미박\s*후지|미\s*후지|미후지)(?=$|[\s()])", "$1미박 뒷다리살"), (rf"(^|[\s(])미(?:빅|밖|백|뱍)(?:피)?\s*(?={CUT_WORDS})", "$1미박 "), (rf"(^|[\s(])미\s*(?={CUT_WORDS})", "$1미박 "))
#: The Hangul letters, in code order.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIALS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"


def replaced(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, plain in rules:
        text = F.regexp_replace(text, pattern, plain)
    return text


#: Full-width forms and their plain ones: what compatibility composition does to the characters that scans contain.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def clean(text: Column) -> Column:
    """Full-width characters as plain ones, white space as single blanks, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), WIDE, PLAIN), r"\s+", " "))


def fingerprint(text: Column) -> Column:
    """A name's letters and digits, in lower case, with known misreads mended and without origins."""
    out = compact(replaced(clean(text), MISREADS))
    for origin in ORIGINS:
        out = F.replace(out, F.lit(origin), F.lit(""))
    return out


def supplier_fingerprint(text: Column) -> Column:
    """A supplier's fingerprint without the form of company before it and the trade after it."""
    return replaced(fingerprint(text), (("^(주식회사|농업회사법인|유한회사)", ""), ("^주", ""), ("유통$", "")))


def syllable(c: Column) -> Column:
    """Number of a Hangul syllable in code order; null for other characters."""
    code = F.ascii(c) - 0xAC00
    return F.when(code.between(0, 11171), code)


def letters(text: Column) -> Column:
    """The text with each Hangul syllable taken apart into its letters."""
    one = lambda s, i: F.substring(F.lit(s), (i + 1).cast("int"), F.lit(1))

    def apart(c: Column) -> Column:
        n = syllable(c)
        last = F.when(n % 28 > 0, one(FINALS, n % 28 - 1)).otherwise("")
        return F.when(n.isNull(), c).otherwise(F.concat(one(INITIALS, F.floor(n / 588)), one(MEDIALS, F.floor(n % 588 / 28)), last))

    return F.array_join(F.transform(F.split(text, ""), apart), "")


def dice(a: Column, b: Column) -> Column:
    """Twice the characters in common, with repeats, over all characters."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    each = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != ""))
    common = F.aggregate(F.transform(each, lambda c: F.least(count(a, c), count(b, c))), F.lit(0), lambda x, y: x + y)
    return 2 * common / F.greatest(F.lit(1), F.length(a) + F.length(b))


def hangul_similarity(a: Column, b: Column) -> Column:
    """The best of: edits of syllables, edits of letters x 0.96, characters in any order x 0.88. Both are fingerprints."""

    def of(p: Column) -> Column:
        x, y = p["a"], p["b"]
        best = F.greatest(similarity(x, y), let(F.struct(letters(x).alias("a"), letters(y).alias("b")), lambda q: similarity(q["a"], q["b"])) * 0.96, dice(x, y) * 0.88)
        return F.when((x == "") | (y == ""), 0.0).otherwise(best)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def term_similarity(text: Column, alias: Column) -> Column:
    """How well the best part of a text's fingerprint, of the alias's length or one more or less, resembles the alias."""
    n = F.length(alias)
    sizes = F.sequence(F.greatest(F.lit(1), n - 1), F.greatest(F.greatest(F.lit(1), n - 1), F.least(F.length(text), n + 1)))
    parts = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - k + 1)), lambda i: F.substring(text, i, k))))
    best = F.array_max(F.transform(F.array_distinct(F.concat(F.array(text), parts)), lambda p: hangul_similarity(p, alias)))
    return F.when(alias == "", 0.0).otherwise(best)


def particle(text: Column) -> Column:
    """The subject particle after a word: by whether its last syllable ends in a consonant."""
    n = syllable(F.right(text, F.lit(1)))
    return F.when(n % 28 > 0, "이").otherwise("가")


def skin(text: Column) -> Column:
    """Whether a name says that pork comes with its skin or without."""
    return let(fingerprint(text), skin_of)


def skin_of(key: Column) -> Column:
    on = key.rlike("미(?:박|빅|밖|백|뱍)(?:피)?") | key.rlike("^(?:냉장|냉동)?미(?:전지|젼지|전쥐|전디|앞다리|압다리|앞다라|후지|뒷다리|삼겹|목살|등심|갈비)")
    off = key.rlike("(?:^|냉장|냉동)(?:박피|박펴|박파|박비|빅피|밖피)")
    return F.when(on, "skin_on").when(off, "skinless").otherwise("unknown")


def canonical(text: Column) -> Column:
    """A name with misreads and synonyms replaced, without origins, evenly spaced."""
    out = replaced(clean(text), SUBSTITUTIONS)
    for origin in ORIGINS:
        out = F.regexp_replace(F.regexp_replace(out, rf"\(\s*{origin}\s*\)", " "), rf"(^|\s){origin}(?=\s|$)", "$1 ")
    out = replaced(out, ((r"\s+", " "), (r"\s*\(\s*", "("), (r"\s*\)\s*", ")"), (r"^(냉장|냉동)\s*", "$1 ")))
    return F.when(F.trim(out) == "", "(미인식)").otherwise(F.trim(out))


def cut(text: Column) -> Column:
    """(cut, category, qualifier) of the first rule whose pattern occurs; null without one."""
    rule = lambda r: F.struct(F.lit(r[1]).alias("cut"), F.lit(r[2]).alias("category"), F.lit(r[3]).alias("qualifier"))
    return let(text, lambda t: F.coalesce(*(F.when(t.rlike(r[0]), rule(r)) for r in CUTS)))


def stated_storage(text: Column) -> Column:
    return F.when(text.contains("냉동"), "냉동").when(text.contains("냉장"), "냉장").otherwise("미표기")


#: What shows that a vendor's name stands behind the product's.
VENDOR = r"(?i)(주식회사|농협|엘피씨|\bLPC\b|도드람|유통회사|축산유통|미트유통)"
#: The words that state a category, by themselves and within a name without blanks; the first that occurs decides.
HINTS = (("돼지|돈육|PIG|PORK", "돼지고기"), ("소고기|쇠고기|우육|한우|육우|CATTLE|BEEF", "소고기"), ("닭|계육|CHICKEN", "닭고기"), ("양고기|LAMB", "양고기"), ("오리|DUCK", "오리고기"), ("염소|GOAT", "염소고기"))
STATED = (
    ("한우|육우|우육|소고기|쇠고기|우삼겹|소삼겹|우목심|우목살|소목심|소목살|차돌|소도가니|우도가니|소채끝|소안심|우안심|소등심|우등심|소사태|우사태|소족|쇠족|소발|소사골|우사골|소힘줄|쇠심줄|우근", "소고기"),
    ("돼지|돈육|돈피|돈족|돈뼈|등뼈|돈갈비|등갈비|쪽갈비|삼겹|목살|항정|가브리|등심덧살", "돼지고기"), ("닭|계육", "닭고기"), ("양고기|램", "양고기"), ("오리", "오리고기"), ("염소", "염소고기"),
)


def first_of(text: Column, rules: tuple[tuple[str, str], ...], flags: str = "") -> Column:
    """What the first pattern that occurs stands for; null without one."""
    return F.coalesce(*(F.when(text.rlike(flags + p), v) for p, v in rules))


def hinted_category(hint: Column) -> Column:
    return first_of(clean(hint), HINTS, "(?i)")


def stated_category(name: Column) -> Column:
    return first_of(F.regexp_replace(clean(name), r"\s+", ""), STATED)


def storage_word(name: Column) -> Column:
    """The storage that a name states, known misreads mended; null without one."""
    return let(replaced(clean(name), MISREADS), lambda t: F.when(t.contains("냉동"), "냉동").when(t.contains("냉장"), "냉장"))


def species(unit: Column, name: Column) -> Column:
    """Species by the words of unit and name; the first rule decides."""
    text = F.concat_ws(" ", unit, name)
    has = lambda *words: F.greatest(*(text.contains(w) for w in words), F.lit(False))
    return F.when(has("돈육", "돼지", "삼겹", "전지"), "돼지").when(has("우육", "한우", "우"), "소").when(has("닭"), "닭").otherwise("기타")


def classified(text: Column) -> Column:
    """(name, category, cut, qualifier, storage, skin, confidence, review, key): what a product name says; the key groups equal products.

    A cut found in the canonical name is sure to 92, with a stated storage to 96; without one the name needs
    review. So does pork whose skin state contradicts its rule.
    """

    def of(x: Column) -> Column:
        rule, store, state = x["rule"], x["storage"], x["skin"]
        known = rule.isNotNull()
        sure = F.when(~known, 40).when(store == "미표기", 92).otherwise(96)
        review = F.when(~known, "CUT_UNKNOWN").when((rule["category"] != "돼지고기") & (state != "unknown"), "SKIN_CONTRADICTS_SPECIES").when((rule["qualifier"] == "미박") & (state == "skinless"), "SKIN_CONTRADICTS_CUT")
        qualifier = F.when((rule["category"] == "돼지고기") & (state == "skin_on"), "미박").otherwise(F.coalesce(rule["qualifier"], F.lit("")))
        key = F.concat_ws("|", F.coalesce(rule["category"], F.lit("미분류")), F.coalesce(rule["cut"], x["print"]), qualifier, store)
        return F.struct(x["name"].alias("name"), rule["category"].alias("category"), rule["cut"].alias("cut"), qualifier.alias("qualifier"), store.alias("storage"), state.alias("skin"), sure.alias("confidence"), review.alias("review"), key.alias("key"))

    def of_names(n: Column) -> Column:
        return let(F.struct(n["name"].alias("name"), n["print"].alias("print"), cut(n["name"]).alias("rule"), stated_storage(n["name"]).alias("storage"), skin_of(n["print"]).alias("skin")), of)

    return let(F.struct(canonical(text).alias("name"), fingerprint(text).alias("print")), of_names)


def standard_aliases(text: Column) -> Column:
    """A name with the variants of seven standard products replaced."""
    for name, pattern in ALIASES:
        text = F.regexp_replace(text, rf"(^|[\s(])(?:{pattern})(?=$|[\s()])", f"$1{name}")
    return text


#: A qualifier that means skin-on pork: 미 alone, or what begins with it, holds a form of 박 and is one edit from 미박 or 미박피.
SKIN_ON = "미(?:[박빅밖백뱍]|박[가-힣]|[가-힣]박|[빅밖백뱍]피|[가-힣]박피|박[가-힣]피|박피[가-힣])?"
BELLY = "(?:삼겹|삼겸|삽겹)(?:살|쌀)?"
#: Names that are nothing but a storage, a qualifier and belly, and the product that they mean.
BELLIES = ((f"^(?:미빅피|미박피|미밖피|미뱍피|미박|미빅|미밖|미백|미뱍|미){BELLY}$", "오겹살"), (f"^(?:박피|박펴|박파|박비|빅피|밖피){BELLY}$", "삼겹살"))


#: Standard products by their names in ALIASES: code, category, cut, qualifier.
STANDARDS = (
    ("오겹살", "DICT-0001", "돼지고기", "삼겹", "미박"), ("미박 앞다리살", "DICT-0002", "돼지고기", "앞다리살", "미박"), ("미박 뒷다리살", "DICT-PORK-LEG-SKIN-ON", "돼지고기", "뒷다리", "미박"), ("이겹살", "DICT-PORK-BELLY-TWO-LAYER", "돼지고기", "이겹살", ""),
    ("가브리살", "DICT-PORK-GABURI", "돼지고기", "가브리살", ""), ("돼지 갈비", "DICT-PORK-RIB", "돼지고기", "갈비", ""), ("삼겹살", "DICT-PORK-BELLY-SKINLESS", "돼지고기", "삼겹", ""),
)


def standard_product(name: Column, skin_state: Column) -> Column:
    """(code, category, cut, qualifier) of the first standard product that a name holds, its variants replaced; plain belly only if the name says that it has no skin."""
    of = lambda s: F.struct(*(F.lit(v).alias(k) for k, v in zip(("code", "category", "cut", "qualifier"), s[1:], strict=True)))
    holds = lambda s: name.contains(s[0]) & (skin_state == "skinless") if s[0] == "삼겹살" else name.contains(s[0])
    return F.coalesce(*(F.when(holds(s), of(s)) for s in STANDARDS))


def contextual_typos(text: Column) -> Column:
    """A name with typing errors of skin-on cuts mended.

    A name that is nothing but a storage and belly with or without skin becomes that product's. Elsewhere a qualifier that is one edit
    from the right ones makes skin-on belly of the belly behind it, which may have one edit too at the name's start.
    """

    def of(name: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), r"\s+", "")
        storage = F.regexp_extract(bare, "^(냉장|냉동)", 1)
        product = first_of(F.substring(bare, F.length(storage) + 1, F.length(bare)), BELLIES)
        part = lambda n: F.regexp_extract(name, rf"^((?:냉장|냉동)\s+)?({SKIN_ON})\s+([가-힣]{{2,6}})(.*)$", n)
        belly = (part(3) != "") & (F.least(F.levenshtein(part(3), F.lit("삼겹")), F.levenshtein(part(3), F.lit("삼겹살"))) <= 1)
        begun = F.when(belly, F.concat(part(1), F.lit("오겹살"), part(4))).otherwise(name)
        mended = F.regexp_replace(begun, rf"(^|[\s(]){SKIN_ON}\s*{BELLY}(?=$|[\s)])", "$1오겹살")
        return F.when(product.isNotNull(), F.concat(F.when(storage != "", F.concat(storage, F.lit(" "))).otherwise(""), product)).otherwise(mended)

    return let(replaced(clean(text), TYPOS), of)
