"""Localized sentences as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence templates by key and language.
TEMPLATES = {
    "start_in": {
        "en": "You are currently in {room} on {floor} of {building}, {place}.",
        "zh": "您目前在{place}{building}{floor}的{room}。",
        "th": "ขณะนี้คุณอยู่ที่ {room} ชั้น {floor} อาคาร {building} ใน {place}",
    },
    "start_nav": {"en": "Starting navigation.", "zh": "开始导航。", "th": "เริ่มการนำทาง"},
    "forward": {"en": "Forward {dist}", "zh": "直行{dist}", "th": "เดินตรงไป {dist}"},
    "forward_door": {
        "en": "Forward {dist} and go through a door in {door_dist}",
        "zh": "直行{dist}，{door_dist}后穿过一扇门",
        "th": "เดินตรงไป {dist} แล้วผ่านประตูที่ {door_dist}",
    },
    "transition_place": {
        "en": "You are approaching the transition to {place}.",
        "zh": "您正接近{place}。",
        "th": "คุณกำลังจะถึง {place}",
    },
    "proceed_to": {
        "en": "Proceed to {floor} of {building} in {place}.",
        "zh": "前往{place}{building}{floor}。",
        "th": "ไปที่ชั้น {floor} อาคาร {building} ใน {place}",
    },
    "approaching_stair": {
        "en": "You are approaching the staircase.", "zh": "您正接近楼梯。", "th": "คุณกำลังจะถึงบันได",
    },
    "approaching_elevator": {
        "en": "You are approaching the elevator.", "zh": "您正接近电梯。", "th": "คุณกำลังจะถึงลิฟต์",
    },
    "approaching_escalator": {
        "en": "You are approaching the escalator.", "zh": "您正接近扶梯。", "th": "คุณกำลังจะถึงบันไดเลื่อน",
    },
    "go_up_stair": {
        "en": "Go {direction} to {floor} of {building} via the staircase.",
        "zh": "通过楼梯{direction}到{building}{floor}。",
        "th": "ใช้บันไดไป {direction} ถึงชั้น {floor} อาคาร {building}",
    },
    "go_up_elevator": {
        "en": "Press the {direction} button to {floor} of {building} using the elevator.",
        "zh": "乘电梯{direction}到{building}{floor}。",
        "th": "ใช้ลิฟต์ไป {direction} ถึงชั้น {floor} อาคาร {building}",
    },
    "go_up_escalator": {
        "en": "Take the escalator {direction} to {floor} of {building}.",
        "zh": "乘扶梯{direction}到{building}{floor}。",
        "th": "ใช้บันไดเลื่อนไป {direction} ถึงชั้น {floor} อาคาร {building}",
    },
    "proceed_to_floor": {
        "en": "Proceed to {floor} of {building}.",
        "zh": "前往{building}{floor}。",
        "th": "ไปที่ชั้น {floor} อาคาร {building}",
    },
    "turn": {
        "en": "{qual} {direction} to {hour} o'clock",
        "zh": "{hour}点方向{qual}{direction}转弯",
        "th": "{qual} เลี้ยว{direction} ไปทาง {hour} นาฬิกา",
    },
    "turn_deg": {
        "en": "Turn {direction} {deg} degrees", "zh": "向{direction}转{deg}度", "th": "เลี้ยว{direction} {deg} องศา",
    },
    "u_turn": {"en": "Make a U-turn", "zh": "掉头", "th": "กลับรถ"},
    "arrive": {
        "en": "{label} on {hour} o'clock {dir_word}",
        "zh": "{label}在{hour}点方向{dir_word}",
        "th": "{label} ที่ {hour} นาฬิกา {dir_word}",
    },
}

# Distance phrases by unit and language.
UNITS = {
    "meter": {"en": "{v} meters", "zh": "{v}米", "th": "{v} เมตร"},
    "meter_1": {"en": "1 meter", "zh": "1米", "th": "1 เมตร"},
    "feet": {"en": "{v} feet", "zh": "{v}英尺", "th": "{v} ฟุต"},
    "feet_1": {"en": "1 foot", "zh": "1英尺", "th": "1 ฟุต"},
}
# Fixed value: feet per metre.
FEET_PER_METRE = 3.28084

# Turn sector words by language.
QUALIFIERS = {
    "en": {
        "very_slight": "very slight", "slight": "slight", "turn": "turn", "sharp": "sharp",
        "very_sharp": "very sharp", "u_turn": "U-turn",
    },
    "zh": {"very_slight": "极小幅", "slight": "小幅", "turn": "", "sharp": "急", "very_sharp": "极急", "u_turn": "掉头"},
    "th": {
        "very_slight": "เอียงเล็กมาก", "slight": "เล็กน้อย", "turn": "เลี้ยว", "sharp": "หัก",
        "very_sharp": "หักมาก", "u_turn": "กลับรถ",
    },
}
# Side words by language.
SIDES = {
    "en": {"left": "left", "right": "right"},
    "zh": {"left": "左", "right": "右"},
    "th": {"left": "ซ้าย", "right": "ขวา"},
}
# Arrival words by language.
ARRIVALS = {
    "en": {
        "ahead": "ahead", "behind": "behind",
        "very_slight_left": "very slight left", "slight_left": "slight left", "turn_left": "left",
        "sharp_left": "sharp left", "very_sharp_left": "very sharp left",
        "very_slight_right": "very slight right", "slight_right": "slight right", "turn_right": "right",
        "sharp_right": "sharp right", "very_sharp_right": "very sharp right", "u_turn": "behind",
    },
    "zh": {
        "ahead": "正前方", "behind": "正后方",
        "very_slight_left": "极小幅左侧", "slight_left": "小幅左侧", "turn_left": "左侧",
        "sharp_left": "急左侧", "very_sharp_left": "极急左侧",
        "very_slight_right": "极小幅右侧", "slight_right": "小幅右侧", "turn_right": "右侧",
        "sharp_right": "急右侧", "very_sharp_right": "极急右侧", "u_turn": "正后方",
    },
    "th": {
        "ahead": "ข้างหน้า", "behind": "ข้างหลัง",
        "very_slight_left": "เอียงซ้ายเล็กมาก", "slight_left": "ซ้ายน้อย", "turn_left": "ซ้าย",
        "sharp_left": "ซ้ายหัก", "very_sharp_left": "ซ้ายหักมาก",
        "very_slight_right": "เอียงขวาเล็กมาก", "slight_right": "ขวาน้อย", "turn_right": "ขวา",
        "sharp_right": "ขวาหัก", "very_sharp_right": "ขวาหักมาก", "u_turn": "ข้างหลัง",
    },
}
# What speech output drops or tightens, as (pattern, replacement) in order.
SPEECH_RULES = (
    (r"[_+@#$%^&*=~`|:\\/]+", " "),
    (r"\s{2,}", " "),
    (r"^\s+|\s+$", ""),
    (r"\s+([,.;:!?])", "$1"),
    (r"\s+([，。！？；：、])", "$1"),
)
#: Where any of the rules finds something; most sentences hold nothing of the kind.
SPEECH_FAULT = r"[_+@#$%^&*=~`|:\\/]|\s{2,}|^\s|\s$|\s[,.;:!?，。！？；：、]"


def lookup(table: dict[str, dict[str, str]], outer: Column, inner: Column) -> Column:
    """table[outer][inner] as a literal map, null when absent."""
    pairs = [(f"{a}|{b}", text) for a, row in table.items() for b, text in row.items()]
    m = F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs)])
    return m[F.concat_ws("|", outer, inner)]


def speakable(text: Column) -> Column:
    said = text
    for pattern, replacement in SPEECH_RULES:
        said = F.regexp_replace(said, F.lit(pattern), F.lit(replacement))
    return F.when(text.rlike(SPEECH_FAULT), said).otherwise(text)


def unit_phrase(value: Column, unit: Column, lang: Column) -> Column:
    n = F.bround(value, 0).cast("long")
    key = F.when(n == 1, F.concat(unit, F.lit("_1"))).otherwise(unit)
    text = F.coalesce(lookup(UNITS, key, lang), lookup(UNITS, key, F.lit("en")))
    return speakable(F.replace(text, F.lit("{v}"), n.cast("string")))


def distance_value(metres: Column, unit: Column) -> Column:
    return F.when(unit == "feet", metres * FEET_PER_METRE).otherwise(metres)


def qualifier_word(qual: Column, lang: Column) -> Column:
    known = F.when(lang.isin(*QUALIFIERS), lang).otherwise("en")
    return F.coalesce(lookup(QUALIFIERS, known, qual), qual)


def side_word(side: Column, lang: Column) -> Column:
    known = F.when(lang.isin(*SIDES), lang).otherwise("en")
    return F.coalesce(lookup(SIDES, known, side), side)


def arrival_word(qual: Column, side: Column, lang: Column, compat: bool = False) -> Column:
    """Word for where the target lies. ``compat`` announces a target behind as "ahead"."""
    known = F.when(lang.isin(*ARRIVALS), lang).otherwise("en")
    token = F.concat_ws("_", qual, side)
    if not compat:
        token = F.when(qual == "u_turn", "u_turn").otherwise(token)
    return F.coalesce(lookup(ARRIVALS, known, token), lookup(ARRIVALS, known, F.lit("ahead")))


def sentence(key: Column, lang: Column, tokens: dict[str, Column], compat: bool = False) -> Column:
    """Render one sentence. ``tokens`` holds raw columns; turn and arrive words are localized here.

    Known tokens: room floor building place dist door_dist direction qual hour deg label.
    """
    qual = tokens.get("qual", F.lit(None).cast("string"))
    side = tokens.get("direction", F.lit(None).cast("string"))
    turned = key.isin("turn", "turn_deg")
    used = F.when(turned & (qual == "u_turn"), "u_turn").otherwise(key)
    text = F.coalesce(lookup(TEMPLATES, used, lang), lookup(TEMPLATES, used, F.lit("en")), F.lit(""))
    values = {k: v for k, v in tokens.items() if k not in ("qual", "direction")}
    values["qual"] = qualifier_word(qual, lang)
    values["direction"] = F.when(turned, side_word(side, lang)).otherwise(side)
    values["dir_word"] = arrival_word(qual, side, lang, compat)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return speakable(text)
