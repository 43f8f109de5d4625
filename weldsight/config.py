"""Constants of the method, at the machine's one-second rate and scaled to slower streams."""

from __future__ import annotations

from dataclasses import dataclass

#: The terminal state code of each fault class, and what the class means.
TERMINAL_CODES = {"E012": "E01", "E016": "E02", "E028": "E03", "E029": "E04"}
CLASS_NAMES = {"E01": "counterbalance timeout", "E02": "electrode broke", "E03": "unwanted movement", "E04": "drift"}
CLASS_SITUATIONS = {"E01": "S01", "E02": "S02", "E03": "S03", "E04": "S04"}

#: Symptom rules as (id, core, auxiliary, classes, situations); a condition is sensor:direction.
SYMPTOMS = (
    ("P1", ("c5:low",), ("c4:high",), ("E01",), ("S01",)),
    ("P2", ("c2:low",), ("c5:low",), ("E01",), ("S05",)),
    ("P3", ("c6:high",), ("c2:low",), ("E03",), ("S06",)),
    ("P4", ("c3:unstable",), (), ("E04",), ("S04",)),
    ("P5", ("c3:high",), (), ("E03", "E02"), ("S08", "S03")),
    ("P6", ("c1:high", "c1:low"), ("c6:high",), ("E02",), ("S07",)),
    ("P7", tuple(f"c{i}:{d}" for i in range(13, 19) for d in ("high", "low", "unstable")), (), (), ("S10",)),
    ("P8", ("error_share_10min:high",), (), (), ("S10",)),
)
#: Conditions that show a symptom in part where its core does not.
WEAK = {"P5": ("c3:low", "c7:high", "c7:low")}
#: Symptoms that need a window without welds.
STANDSTILL = ("P4",)


#: Wording of hand-off documents. Sensors as (English, Korean, group), symptoms and fault classes in Korean.
SENSOR_WORDS = {
    "c1": ("Electrode cap offset", "전극 캡 오프셋", "electrode"), "c2": ("Electrode force", "전극 힘", "force"), "c3": ("Electrode position", "전극 위치", "position"),
    "c4": ("Force build-up", "힘 형성 시간", "force"), "c5": ("Balance pressure", "보정(밸런스) 압력", "compensation"), "c6": ("Friction", "마찰", "friction"),
    "c7": ("Maximum aperture", "최대 열림 폭", "position"), "c8": ("Maximum electrode force", "최대 전극 힘", "force"), "c9": ("Start friction", "시작 마찰", "friction"),
    "c10": ("US2", "US2 작동 허용 신호", "io"), "c13": ("Setpoint counterbalance pressure", "보정 압력 설정값", "setpoint"), "c14": ("Setpoint electrode force", "전극 힘 설정값", "setpoint"),
    "c15": ("Setpoint electrode position", "전극 위치 설정값", "setpoint"), "c16": ("Setpoint sheet thickness", "판 두께 설정값", "setpoint"), "c17": ("Setpoint velocity", "속도 설정값", "setpoint"),
    "c18": ("Setpoint force build-up", "힘 형성 설정값", "setpoint"), "welds_delta": ("Welds per second", "초당 용접 수", "activity"), "pos_delta": ("Position moves per second", "초당 위치 이동 수", "activity"),
    "welds_10min": ("Welds in last 10 min", "10분 용접 수", "activity"), "weld_duty_10min": ("Welding duty cycle (10 min)", "10분 용접 비율", "activity"),
    "error_share_10min": ("Share of time in error state (10 min)", "10분 에러 상태 비율", "activity"),
}
DIRECTION_WORDS = {"high": "평소보다 높음", "low": "평소보다 낮음", "unstable": "평소보다 불안정", "off": "꺼짐(평소 켜짐)", "on": "켜짐(평소 꺼짐)"}
SYMPTOM_WORDS = {"P1": "보정 압력 저하 + 힘 형성 지연", "P2": "전극 힘 저하 + 보정 압력 저하", "P3": "마찰 증가 + 전극 힘 저하", "P4": "정지 중 전극 위치 흔들림", "P5": "동작 중 전극 위치·열림 폭 이탈", "P6": "캡 오프셋 변화", "P7": "설정값 변화", "P8": "에러 상태 비율 증가", "P9": "센서 신호 없음"}
CLASS_WORDS = {"E01": "보정 압력 도달 지연", "E02": "전극 파손", "E03": "의도하지 않은 움직임", "E04": "드리프트"}
CLASS_DEFINITIONS = {"E01": "compensation pressure not reached within 1800 ms", "E02": "electrode position below the zero point of the reference travel", "E03": "position deviates by more than 6.5 % of the stroke", "E04": "locked cylinder moves by 5 mm a minute or more"}
CAVEATS = (
    "증상 규칙은 매뉴얼 기반이며 데이터로 학습된 관계가 아님 - 원인 확정이 아니라 조회 후보",
    "고장 유형 근거는 주로 종료 코드 규칙",
    "종료 코드 규칙은 다른 클래스 건에서도 뜰 수 있음",
    "센서 방향(높음/낮음)은 이 gun의 워밍업 평균 대비 z-score 기준",
)


@dataclass(frozen=True)
class Profile:
    """Seconds-based constants; a slot is the grid's step."""

    slot_s: int = 1
    gap_slots: int = 60
    rolling_slots: int = 600
    window_slots: int = 60
    label_s: int = 3600
    rule_s: int = 600
    warmup_s: int = 21_600
    warmup_rows: int = 600
    warmup_windows: int = 10
    std_floor: float = 0.25
    quantile: float = 0.99
    sustain: int = 3
    gate: float = 0.5
    cooldown_s: int = 1800
    repeat_s: int = 86_400
    false_after_s: int = 86_400
    lead_s: int = 1800

    @property
    def min_samples(self) -> int:
        return max(2, self.window_slots // 2)


REAL = Profile()
#: For the event table: ten-minute slots, hours for minutes and days for hours.
SCALED = Profile(600, 6, 36, 6, 86_400, 21_600, 432_000, 50, 10, 0.25, 0.9, 2, 0.5, 21_600, 259_200, 259_200, 21_600)
