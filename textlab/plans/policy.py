"""Settings of a corpus of policy statements and speeches: taxonomy, indicators, examples, review rules and page selectors."""

from __future__ import annotations

from ..operators.html import PageRules
from .config import Indicator, Taxonomy

# Fixed values of that corpus: label names, patterns, selectors and the wording of results.
DIRECTIONS = ("引き締め的", "中立的", "緩和的", "該当なし")
FUNCTIONS = ("政策行動", "政策の根拠", "経済見通し", "リスク・不確実性", "期待形成", "背景・その他")
CERTAINTIES = ("明確", "条件付き", "慎重", "該当なし")
PHASES = {"before": "before", "transition": "post", "after": "post", "pre_end_nirp": "before", "end_nirp": "post", "post_end_nirp": "post"}
TYPES, PHASE_ORDER = ("statement", "speech"), ("before", "post")
CEREMONIAL = ("本日は", "お招き", "ご紹介", "挨拶", "講演の機会", "ありがとうございました", "懇談会", "当地", "地域経済", "県内", "支店長", "皆様", "御礼")
DROP_TAGS = ("script", "style", "noscript", "header", "footer", "nav", "aside", "form")
DROP_SELECTORS = ("#header_area", "#footer", "#topic_path", "#sns", "#overlay", ".block_skip", ".search_form", ".link-list01", ".lang", ".visually-hidden", ".txt-hide", "[role='navigation']", "[role='search']", "button", "input", "select", "option", "datalist", "img", "svg")
MAIN_SELECTORS = ("main#contents", "article", "main", "#contents", ".contents", ".article")
NOTES = {"A": "Higher values may be relevant to Narrative A, but do not prove it.", "B": "Higher values may be relevant to Narrative B, but do not prove it."}
TIGHT, BASIS, CLEAR, ACTION, CONDITIONAL, CAREFUL = "引き締め的", "政策の根拠", "明確", "政策行動", "条件付き", "慎重"

FIELDS = ("policy_direction", "communication_function", "certainty")
TAXONOMY = Taxonomy(dict(zip(FIELDS, (DIRECTIONS, FUNCTIONS, CERTAINTIES), strict=True)))
PAGES = PageRules(drop_tags=DROP_TAGS, drop=DROP_SELECTORS, main=MAIN_SELECTORS)


def field_of(label: str) -> str:
    return next(f for f, labels in TAXONOMY.fields.items() if label in labels)


def having(*labels: str, **where: str) -> str:
    """The SQL condition that a row has these labels and values."""
    both = {field_of(x): x for x in labels} | where
    return " AND ".join(f"{c} = '{v}'" for c, v in both.items())


def _indicator(narrative: str, name: str, labels: tuple[str, ...], **where: str) -> Indicator:
    group = "; ".join(f"{c}={v}" for c, v in where.items())
    return Indicator(f"Narrative {narrative}", name, group, having(**where), having(*labels), NOTES[narrative])


def _share(label: str) -> str:
    return f"{field_of(label)}={label}"


_POST = {"type": "speech", "phase": "post"}
INDICATORS: list[Indicator] = [
    *[_indicator("A", f"Proportion of {TIGHT} chunks by type and phase", (TIGHT,), type=t, phase=p) for t in TYPES for p in PHASE_ORDER],
    _indicator("A", f"Proportion of {BASIS} chunks in speeches", (BASIS,), type="speech"),
    *[_indicator("A", f"Proportion of {CLEAR} chunks by document type", (CLEAR,), type=t) for t in TYPES],
    *[_indicator("A", f"Post-period speech proportion: {_share(x)}", (x,), **_POST) for x in (TIGHT, BASIS, CLEAR)],
    _indicator("A", f"Post-period speech joint proportion: {TIGHT} × {BASIS} × {CLEAR}", (TIGHT, BASIS, CLEAR), **_POST),
    *[_indicator("B", f"Statement proportion: {_share(x)}", (x,), type="statement") for x in (ACTION, CLEAR)],
    _indicator("B", f"Statement joint proportion: {ACTION} × {CLEAR}", (ACTION, CLEAR), type="statement"),
    *[_indicator("B", f"Speech proportion: {_share(x)}", (x,), type="speech") for x in (CONDITIONAL, CAREFUL, FUNCTIONS[3], FUNCTIONS[4])],
    *[_indicator("B", f"Speech joint proportion: {TIGHT} × {x}", (TIGHT, x), type="speech") for x in (CONDITIONAL, CAREFUL)],
    *[_indicator("B", f"Post-period speech proportion: {_share(x)}", (x,), **_POST) for x in (CONDITIONAL, CAREFUL)],
]

EXAMPLES: dict[str, str] = {
    **{_share(x): having(x) for x in (*DIRECTIONS[:3], *FUNCTIONS[:5], *CERTAINTIES[:3])},
    f"statement: {ACTION} × {CLEAR}": having(ACTION, CLEAR, type="statement"),
    f"speech: {BASIS}": having(BASIS, type="speech"),
    f"speech: {FUNCTIONS[3]} × {CAREFUL}": having(FUNCTIONS[3], CAREFUL, type="speech"),
    f"speech: {TIGHT} × {CONDITIONAL}": having(TIGHT, CONDITIONAL, type="speech"),
    **{f"phase={p}": having(phase=p) for p in PHASE_ORDER},
}

#: Reasons to review a row, in order; what evidence, combinations and patterns give stands between the two parts.
RULES_BEFORE = [
    ("policy_direction is 該当なし but certainty is substantive", "policy_direction = '該当なし' AND certainty <> '該当なし'"),
    ("background/other function paired with directional policy label", "communication_function = '背景・その他' AND policy_direction IN ('引き締め的', '緩和的')"),
]
RULES_AFTER = [("引き締め的 paired with 慎重", "policy_direction = '引き締め的' AND certainty = '慎重'"), ("緩和的 paired with 明確", "policy_direction = '緩和的' AND certainty = '明確'")]
REASONS = {"short": "evidence has fewer than 5 visible characters", "lost": "evidence text not found inside chunk text", "rare": "three-label combination appears fewer than 2 times", "ceremonial": "text appears ceremonial or regional-background oriented"}

#: Pairs of function and certainty that a chart shows.
PAIRS = [(ACTION, CLEAR), (BASIS, CLEAR), (BASIS, CONDITIONAL), (FUNCTIONS[3], CAREFUL)]
