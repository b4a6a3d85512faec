"""Repair of extracted Korean text: glued words, displaced quantities, province names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every name that a province goes by.
PROVINCES = {
    "서울특별시": ("서울", "서울시"),
    "부산광역시": ("부산", "부산시"),
    "대구광역시": ("대구", "대구시"),
    "인천광역시": ("인천", "인천시"),
    "광주광역시": ("광주", "광주시"),
    "대전광역시": ("대전", "대전시"),
    "울산광역시": ("울산", "울산시"),
    "세종특별자치시": ("세종", "세종시"),
    "경기도": ("경기",),
    "강원특별자치도": ("강원", "강원도"),
    "충청북도": ("충북",),
    "충청남도": ("충남",),
    "전북특별자치도": ("전북", "전라북도"),
    "전라남도": ("전남",),
    "경상북도": ("경북",),
    "경상남도": ("경남",),
    "제주특별자치도": ("제주", "제주도"),
}
_NAMES = sorted({n for k, v in PROVINCES.items() for n in (k, *v)}, key=lambda n: (-len(n), n))

#: Fixed values: (name, what stands before a lost blank, what stands after it), in order of use.
GLUED = (
    ("locative_subject", "에서", "재해자|작업자|근로자"),
    ("site_particle", r"(?:작업장|사업장|공사현장|벌목현장|산림\s*방제\s*현장|현장|축사|공장|처리장|창고|야적장|항만|계선주)에서", "지게차|엘리베이터|천장크레인|벌목|차량탑재형|재해자|작업자|근로자|크레인|굴착기|고소작업대|벽체|파일|철골|자재|차량|판넬|H빔"),
    ("subject_boundary", "(?:재해자|작업자|근로자)가", "[가-힣]"),
    ("during_work", r"작업\s*중", "(?!이|인|에|의|으|지|단|임|량|독)[가-힣]"),
    ("while_action", r"하던\s*중", "(?!이|인|에|의|으|지|단|임)[가-힣]"),
    ("fall_result", "넘어져", "(?!서|도)[가-힣]"),
    ("transport_modifier", "운반하던", "중|입식|좌식|전동|수동|지게차|자재|H빔|보일러|철선|코일|곡물"),
    ("purpose_boundary", r"(?:이동하기|진입하기|접근하기)\s*위해", "엘리베이터|고소작업대|사다리|작업대|계단|통로"),
    ("after_connector", "(?:탑승하여|접촉하여|부딪혀)", r"(?!서|야|도(?:\s|$|[.,;:]))[가-힣]"),
    ("after_collision", r"부딪힌\s*후", "접안시설|벽체|차량|설비|구조물"),
    ("pushed_body", "밀리자", "몸으로"),
    ("while_riding", "채로", "후진"),
    ("forklift_subject", "지게차가", "넘어져"),
    ("beam_chain", "H빔이", "연쇄적으로"),
    ("pipe_subject", "강관이", "재해자"),
    ("fall_then_falling", "떨어져", "낙하하는"),
    ("fall_then_subject", "떨어져", "재해자|작업자|근로자"),
    ("cause_then_lifting", "인해", "인양"),
    ("during_adjacent", r"작업\s*중", "인접한"),
    ("climb_panel", "올라가", "판넬|고압전선"),
    ("roller_collision", "롤러에", "부딪혀"),
    ("site_equipment_extended", "(?:공사현장|사업장|벌목현장|야적장|물류센터|센터)에서", "윈치|섬유로프|다른|도보|배수관|화물차량|반응기|적재물|이동|타워크레인"),
    ("connector_noun_extended", "(?:연결하여|못하여|충격하여)", "사상|화물차량|중심"),
    ("during_lifting_hook", r"작업\s*중", "인양고리"),
)
#: The parts of a report's compact head with what may stand between them; blanks belong there.
_HEAD = (
    ("", r"\([월화수목금토일]\)"),
    ("", r"\d{1,2}:\d{2}경"),
    ("", rf"(?:{'|'.join(_NAMES)})"),
    (r"\s+", "[가-힣]{2,12}(?:시|군|구)"),
    (r"\s+", "소재"),
    ("", "(?:O{2,}|0{2,}|○{2,}|X{2,})"),
    ("", "공사현장"),
    ("", r"\d+층"),
    ("", "[가-힣]{1,12}에서"),
    ("", "[가-힣]{2,20}공사"),
)
HEAD = "(?i)" + "".join(f"{between}({part})" for between, part in _HEAD)
#: Fixed value: unit, count unit, duration and count of an exercise as extraction displaces them.
QUANTITY = r"\s*(초|분|시간)\s+이상\s+을\s+(회)\s+이상\s+\(\s*(\d+)(?:\s*([~∼～-])\s*(\d+))?\s*\)\s*(\d+)\s+반복"


def repair_glued(text: Column) -> Column:
    """Blanks put back where one of the known pairs stands glued; other text stays."""
    for _, before, after in GLUED:
        text = F.regexp_replace(text, f"(?U)({before})(?={after})", "$1 ")
    return F.regexp_replace(text, f"(?U){HEAD}", " ".join(f"${i + 1}" for i in range(len(_HEAD))))


def glued_left(text: Column) -> Column:
    """Names of the known pairs that stand glued, in order; empty for NULL."""

    def left(one: Column) -> Column:
        found = [F.when(one.rlike(f"(?U)(?:{before})(?={after})"), name) for name, before, after in GLUED]
        return F.array_compact(F.array(*found, F.when(one.rlike(f"(?U){HEAD}"), "compact_domestic_accident_header")))

    # one element, so that a text that is itself computed is computed once
    return F.transform(F.array(text), left)[0]


def repair_quantities(text: Column) -> Column:
    """Duration and repetitions in reading order, as in "(5~6초 이상)을 3회 이상 반복"."""
    return F.regexp_replace(text, f"(?U){QUANTITY}", "($3$4$5$1 이상)을 $6$2 이상 반복")


def province(name: Column) -> Column:
    """A province's full name from any of its names; NULL for others."""
    out = F.lit(None).cast("string")
    for whole, short in PROVINCES.items():
        out = F.when(F.trim(name).isin(whole, *short), whole).otherwise(out)
    return out
