"""Word lists, patterns and numbers that results depend on. Arabic values are those of the legal domain."""

from __future__ import annotations

# -- Fixed values: text ----------------------------------------------------------------------------------------------
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
EXTENDED_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
#: Vowel signs and the elongation stroke.
MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
LETTER_FORMS = ("إأآٱىةؤئ", "اااايهوي")
PREFIXES = ("والـ", "بال", "كال", "فال", "وال", "ال", "لل")
SUFFIXES = ("اتها", "ياته", "اتهم", "ونها", "ات", "ون", "ين", "ان", "ها", "هم", "هن", "كم", "ية", "ه", "ي", "ا", "ه")
LEAST_STEM = 3
BIS = "مكرر"
BIS_FORMS = "مكرر(?:ات|ا|اً|ًا)?"

#: Ordinals from 1 to 10: feminine and masculine; 11 to 19 add the tens word.
ORDINAL_UNITS = (
    ("الأولى", "الأول"), ("الثانية", "الثاني"), ("الثالثة", "الثالث"), ("الرابعة", "الرابع"), ("الخامسة", "الخامس"),
    ("السادسة", "السادس"), ("السابعة", "السابع"), ("الثامنة", "الثامن"), ("التاسعة", "التاسع"), ("العاشرة", "العاشر"),
)
ORDINAL_ELEVENTH = ("الحادية", "الحادي")
ORDINAL_TEENS = ("عشرة", "عشر")
ORDINAL_TWENTIETH = ("العشرون", "العشرين")

#: Types of instruments that a formula may name.
KIND_TYPES = {"قانون": ("law",), "مرسوم بقانون": ("dl",), "مرسوم": ("dec", "dl"), "قرار": ("ord",), "أمر": ("ord", "dec")}
TYPE_NAMES = {"law": "قانون", "dl": "مرسوم بقانون", "dec": "مرسوم", "ord": "قرار", "reg": "لائحة"}
TYPE_WORDS = {"law": ("قانون",), "dl": ("مرسوم بقانون", "مرسوم رقم", "بقانون"), "dec": ("مرسوم",), "ord": ("قرار",), "reg": ("لائحة", "نظام")}

# -- Fixed values: verification --------------------------------------------------------------------------------------
_NOT_NEGATED = "(?<!لا )(?<!لم )(?<!لن )(?<!ولا )(?<!ألا )"
#: Modal frames in the order of their tests.
FRAMES = {
    "prohibition": r"(?:لا|لم|لن)\s+(?:يجوز|يحق|يصح|يسوغ)|يحظر|يمنع|محظور|ممنوع",
    "nullity": r"باطل|بطلان|لاغ|كأن\s+لم\s+يكن",
    "exception": r"لا\s+تسري|لا\s+تنطبق|لا\s+يسري|استثن|[يتم]ستثن|مع\s+عدم\s+الإخلال|فيما\s+عدا",
    "obligation": r"يجب|يتعين|يلتزم|ملزم|وجوب|إلزام|على\s+\S+\s+أن",
    "permission": _NOT_NEGATED + r"(?:يجوز|يحق|جائز)|له\s+أن|للعامل\s+أن",
    "entitlement": _NOT_NEGATED + r"(?:يستحق|تستحق|استحقاق)|له\s+الحق",
}
STRONG_FRAMES = ("prohibition", "nullity", "obligation")
STOP_WORDS = (
    "من في على الى عن مع او ان انه التي الذي ما لا قد كل هذا هذه ذلك به بها له لها هو هي كان كانت يكون تكون لم لن "
    "غير بين عند بعد قبل حيث لما فان وان اذا الا سوي ايض كذلك ثم بموجب احكام حكم نص ماده قانون وفق طبق مقتضي مفاد شان"
).split()
MIN_OVERLAP = 0.35
LEGAL_SECTION = "الأسانيد|السند القانوني|التكييف|النصوص|الأساس القانوني|المرافعة|الدفوع|أسباب"
SOURCE_TIERS = {
    "gazette": "الجريدة الرسمية — المرجع الملزم",
    "primary": "هيئة التشريع — مرجع ثانوي رسمي، يُتحقق من الجريدة",
    "ministry": "جهة رسمية — مرجع ثانوي، يُتحقق من الجريدة",
    "authority": "جهة رسمية — مرجع ثانوي، يُتحقق من الجريدة",
    "legislature": "مجلس النواب — مرجع ثانوي، يُتحقق من الجريدة",
    "portal": "بوابة حكومية — مرجع ثانوي، يُتحقق من الجريدة",
}

# -- Fixed values: numbers and units (folded spelling) ----------------------------------------------------------------
ONES = {
    "واحد": 1, "واحده": 1, "احد": 1, "اول": 1, "اثنان": 2, "اثنين": 2, "ثنتان": 2, "ثنتين": 2, "ثلاث": 3, "ثلاثه": 3, "ثالث": 3,
    "اربع": 4, "اربعه": 4, "رابع": 4, "خمس": 5, "خمسه": 5, "خامس": 5, "ست": 6, "سته": 6, "سادس": 6, "سبع": 7, "سبعه": 7, "سابع": 7,
    "ثمان": 8, "ثمانيه": 8, "ثماني": 8, "ثامن": 8, "تسع": 9, "تسعه": 9, "تاسع": 9, "عشر": 10, "عشره": 10, "عاشر": 10,
}
TENS = {
    "عشرون": 20, "عشرين": 20, "ثلاثون": 30, "ثلاثين": 30, "اربعون": 40, "اربعين": 40, "خمسون": 50, "خمسين": 50, "ستون": 60, "ستين": 60,
    "سبعون": 70, "سبعين": 70, "ثمانون": 80, "ثمانين": 80, "تسعون": 90, "تسعين": 90,
}
HUNDREDS = {
    "مايه": 100, "مئه": 100, "مايتان": 200, "مايتين": 200, "مئتان": 200, "مئتين": 200, "ثلاثمايه": 300, "اربعمايه": 400, "خمسمايه": 500,
    "ستمايه": 600, "سبعمايه": 700, "ثمانمايه": 800, "تسعمايه": 900,
}
THOUSANDS = {"الف": 1000, "الفان": 2000, "الفين": 2000, "الاف": 1000}
PERCENT_WORDS = ("بالمايه", "بالمئه")
UNITS = {
    "يوم": "يوم", "ايام": "يوم", "يوما": "يوم", "اسبوع": "اسبوع", "اسابيع": "اسبوع", "اسبوعا": "اسبوع", "شهر": "شهر", "اشهر": "شهر", "شهور": "شهر",
    "شهرا": "شهر", "سنه": "سنه", "سنوات": "سنه", "سنين": "سنه", "عام": "سنه", "اعوام": "سنه", "ساعه": "ساعه", "ساعات": "ساعه", "دينار": "دينار",
    "دنانير": "دينار", "دينارا": "دينار",
}
DUALS = {
    "يومين": "يوم", "يومان": "يوم", "اسبوعين": "اسبوع", "اسبوعان": "اسبوع", "شهرين": "شهر", "شهران": "شهر", "سنتين": "سنه", "سنتان": "سنه",
    "عامين": "سنه", "ساعتين": "ساعه", "ساعتان": "ساعه",
}
#: Words between a number and its unit are passed over, so many tokens far.
UNIT_REACH = 3

# -- Fixed values: fields ---------------------------------------------------------------------------------------------
MONTHS = {
    "يناير": 1, "كانون الثاني": 1, "فبراير": 2, "شباط": 2, "مارس": 3, "اذار": 3, "ابريل": 4, "أبريل": 4, "نيسان": 4, "مايو": 5, "ايار": 5,
    "يونيو": 6, "حزيران": 6, "يوليو": 7, "تموز": 7, "اغسطس": 8, "أغسطس": 8, "اب": 8, "سبتمبر": 9, "ايلول": 9, "اكتوبر": 10, "أكتوبر": 10,
    "تشرين الاول": 10, "نوفمبر": 11, "تشرين الثاني": 11, "ديسمبر": 12, "كانون الاول": 12,
}
HIJRI_MONTHS = ("محرم", "صفر", "ربيع الاول", "ربيع الثاني", "جمادى الاولى", "جمادى الاخره", "رجب", "شعبان", "رمضان", "شوال", "ذو القعده", "ذو الحجه")
HIJRI = "هجري:"
CURRENCIES = r"دينار\w*|د\.?\s?ب|BHD|فلس\w*|ريال\w*|دولار\w*|درهم\w*"
LEADING_CURRENCIES = r"BHD|د\.?\s?ب"
PERCENT_SIGNS = "%|٪|بالمائة|في المائة|بالمئة"
TOTAL_WORDS = ("المجموع", "الاجمالي", "الإجمالي", "جمله", "جملة", "الكلي")
UNIT_SURFACES = {
    "يوم": ("يوما", "أيام", "ايام", "يومين", "يومًا", "يوم"),
    "اسبوع": ("اسابيع", "أسابيع", "اسبوعين", "اسبوعا", "اسبوع"),
    "شهر": ("اشهر", "أشهر", "شهور", "شهرين", "شهرًا", "شهرا", "شهر"),
    "سنه": ("سنوات", "سنين", "سنتين", "اعوام", "أعوام", "عامين", "سنة", "سنه", "عام"),
    "ساعه": ("ساعات", "ساعتين", "ساعة", "ساعه"),
}
DURATION_CAPS = {"سنه": 150, "شهر": 1200, "اسبوع": 5200, "يوم": 36500, "ساعه": 100000}
DURATION_DAYS = {"يوم": 1.0, "اسبوع": 7.0, "شهر": 30.44, "سنه": 365.25}
SPAN_WORDS = "من|خلال|لمده|لمدة|حتى|الى|إلى"
DINAR = "دينار"
UNREADABLE = ("غير مقروء", "غير مقروءة", "غير واضح")

#: Links with these starts lead to no page.
SKIPPED_SCHEMES = ("javascript:", "mailto:", "tel:", "data:", "#")

# -- Fixed values: contracts ------------------------------------------------------------------------------------------
PLACEHOLDER = r"<[^<>\n]{1,80}>|\[اختر:[^\]\n]{1,160}\]"

# -- Fixed values: calibration ----------------------------------------------------------------------------------------
MIN_ARTICLES, LEAST_ARTICLES, MIN_WORDS = 150, 20, 12
FLOOR, CEILING, MISS_RATE, SAMPLES, SEED = 0.25, 0.75, 0.05, 600, 20260903


def ordinals() -> dict[str, int]:
    """Ordinal words of 1 to 20 in both genders, with and without the hamza of the first."""
    out: dict[str, int] = {}
    for g in (0, 1):
        for n, forms in enumerate(ORDINAL_UNITS, 1):
            out[forms[g]] = n
            if 2 <= n <= 9:
                out[f"{forms[g]} {ORDINAL_TEENS[g]}"] = n + 10
        out[f"{ORDINAL_ELEVENTH[g]} {ORDINAL_TEENS[g]}"] = 11
        out[ORDINAL_TWENTIETH[g]] = 20
    return out | {w.replace("أ", "ا"): n for w, n in out.items()}
