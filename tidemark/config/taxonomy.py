"""Keyword taxonomy and fixed label / reason texts.

Fixed values: these strings must equal the original pipeline's configuration
for scores, tags and reasons to match. Order is semantic (first type wins,
tags follow config order).
"""
from __future__ import annotations

# ---- fixed values: default taxonomy (types, fields, audiences, exclusions) ----
DEFAULT_TAXONOMY = {
    "types": {
        "contest": {"label": "공모전", "keywords": ["공모전", "경진대회", "콘테스트", "챌린지", "대회"]},
        "support": {"label": "지원사업", "keywords": ["지원사업", "제작지원", "사업화", "창업지원", "지원금", "입주기업", "참가기업"]},
        "hackathon": {"label": "해커톤·게임잼", "keywords": ["해커톤", "아이디어톤", "게임잼", "game jam"]},
        "event": {"label": "행사·네트워킹", "keywords": ["컨퍼런스", "세미나", "밋업", "네트워킹", "박람회", "전시회", "데모데이"]},
        "education": {"label": "교육·프로그램", "keywords": ["교육", "부트캠프", "아카데미", "멘토링", "프로그램", "캠프"]},
        "supporters": {"label": "서포터즈", "keywords": ["서포터즈", "기자단", "홍보단"]},
        "employment": {"label": "채용·인턴", "keywords": ["채용", "인턴", "인턴십", "신입", "취업"]},
        "other": {"label": "기타", "keywords": []},
    },
    "fields": {
        "game": ["게임", "게임개발", "게임기획", "인디게임", "게임그래픽", "게임아트", "게임사운드", "e스포츠"],
        "indie": ["인디게임", "인디 게임", "indie"],
        "ai": ["인공지능", "생성형 ai", "ai", "aix", "genai", "aiengineering", "머신러닝", "machine learning"],
        "software": ["소프트웨어", "sw", "프로그래밍", "코딩", "개발자", "ict", "it", "api", "알고리즘", "컴퓨터",
                     "시스템", "오픈소스", "임베디드", "자동화", "디지털 전환", "dx", "ax"],
        "web_app": ["웹", "앱", "모바일", "saas", "플랫폼", "it 서비스"],
        "data": ["데이터", "빅데이터", "데이터분석"],
        "immersive": ["메타버스", "vr", "ar", "xr"],
        "cloud_security": ["클라우드", "보안", "오픈소스"],
        "startup": ["스타트업", "창업", "사업화"],
        "digital_content": ["디지털 콘텐츠", "콘텐츠 제작", "인터랙티브", "콘텐츠", "캐릭터", "웹툰", "애니메이션",
                            "미디어아트", "3d", "그래픽"],
    },
    "audiences": {
        "university": ["대학생", "대학원생", "재학생", "대학생 대상"],
        "youth": ["청년", "만 19세", "만 34세", "만 39세"],
        "developer": ["개발자", "프로그래머"],
        "startup": ["예비창업자", "초기창업자", "스타트업", "중소기업"],
    },
    "exclude_phrases": [
        "스포츠 경기 관람", "경품 이벤트", "단순 체험단", "할인 행사", "상품 판매",
        "보험 서포터즈", "식품 서포터즈", "화장품 서포터즈", "입찰", "용역",
    ],
}

# ---- fixed values: display labels for field and audience ids ----
FIELD_LABELS = {
    "game": "게임", "indie": "인디", "ai": "AI", "software": "소프트웨어", "web_app": "웹·앱",
    "data": "데이터", "immersive": "XR·메타버스", "cloud_security": "클라우드·보안",
    "startup": "창업", "digital_content": "디지털 콘텐츠",
}
AUDIENCE_LABELS = {"university": "대학생", "youth": "청년", "developer": "개발자", "startup": "창업자·기업"}

# ---- fixed values: format phrases ----
CATEGORY_FORMAT_PHRASES = ("게임/소프트웨어", "웹/모바일/it", "디지털 콘텐츠")
STRONG_FORMAT_PHRASES = ("게임 출품", "게임 형태", "인터랙티브 콘텐츠", "디지털 콘텐츠")

# ---- fixed values: reason texts ----
REASON_TITLE = "제목 핵심 키워드: "
REASON_BODY = "본문·분류 키워드: "
REASON_TYPE = "공고 유형: "
REASON_SPECIALIST = "IT·게임 전문 출처"
REASON_OFFICIAL = "공식 전문기관 출처"
REASON_CATEGORY = "원본 분류상 게임·IT·디지털 콘텐츠로 참가 가능"
REASON_STRONG = "게임·디지털 콘텐츠 형태로 참가 가능"
REASON_EXCLUDED = "제외 문맥: "
REASON_NO_DIRECT = "제목의 IT·게임 직접 근거 부족"
REASON_NONE = "관련성 근거 부족"
REASON_MANUAL = "YAML 수동 승인"

# ---- fixed values: default texts ----
SUMMARY_DEFAULT = "지원 대상과 세부 내용은 원문 확인 필요"
SUMMARY_PADDING = "참가 조건, 세부 일정, 제출 항목과 신청 방법은 주최기관의 최신 원문 공고에서 반드시 확인하세요."
DETAIL_DEFAULT = "상세 정보는 원문 확인 필요"
MANUAL_SOURCE_NAME = "수동 등록"

# ---- fixed values: enumerations ----
TYPES = ("contest", "support", "hackathon", "event", "education", "supporters", "employment", "other")
STATUSES = ("upcoming", "open", "urgent", "today", "closed", "ongoing", "unknown")
DATE_KINDS = ("exact", "ongoing", "first_come", "budget", "unknown", "inquiry")
RUN_STATES = ("success", "failed", "skipped")
DECISIONS = ("publish", "review", "exclude")

# ---- fixed values: display labels (query layer) ----
TYPE_LABELS = {
    "contest": "공모전", "support": "지원사업", "hackathon": "해커톤·게임잼", "event": "행사·네트워킹",
    "education": "교육·프로그램", "supporters": "서포터즈", "employment": "채용·인턴", "other": "기타",
}
STATUS_LABELS = {
    "upcoming": "접수예정", "open": "접수중", "urgent": "긴급", "today": "오늘마감", "closed": "마감",
    "ongoing": "상시모집", "unknown": "날짜 미상",
}
QUICK_TAGS = ("대학생", "인디", "AI", "NEW", "UPDATED", "마감임박")
PAGE_SIZE = 50
D_DAY_ONGOING = "상시"
D_DAY_UNKNOWN = "미정"
D_DAY_TODAY = "D-DAY"
D_DAY_NONE = "—"
DATE_UNKNOWN = "미정"
