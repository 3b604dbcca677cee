"""Session set, completeness targets and colour thresholds as data, so every variant shares one code path."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Labels and thresholds that consumers compare literally.
FULL_DAY = "🚀 Full Day"
PRE_ONLY = "🌙 Pre-Market Only"
REG_ONLY = "☀️ Regular Session Only"
POST_ONLY = "🌆 Post-Market Only"
MODES = (FULL_DAY, PRE_ONLY, REG_ONLY, POST_ONLY)

GREEN, YELLOW, ORANGE, RED, EMPTY = "#285E28", "#5E5B28", "#5E4228", "#5E2828", "#262626"

SEED_TICKERS = (
    "AMD", "AMZN", "AAPL", "AVGO", "BABA", "GOOGL", "LRCX", "META", "MSFT", "MU", "NVDA", "ORCL", "PANW", "QCOM",
    "SHOP", "TSLA", "TSM", "SPY", "QQQ", "IWM", "DIA",
)

GAP_RATIO = 0.9


@dataclass(frozen=True)
class Session:
    """A market session in Eastern wall-clock minutes; later priorities win a shared edge bar."""

    name: str
    label: str
    start_minute: int
    end_minute: int
    expected: int
    priority: int
    only_mode: str


PRE = Session("PRE", "Pre", 4 * 60, 9 * 60 + 30, 330, 0, PRE_ONLY)
REG = Session("REG", "Reg", 9 * 60 + 30, 16 * 60, 390, 1, REG_ONLY)
POST = Session("POST", "Post", 16 * 60, 20 * 60, 240, 2, POST_ONLY)


@dataclass(frozen=True)
class Profile:
    """What a deployment harvests and how it grades it."""

    sessions: tuple[Session, ...]
    #: filter -> ((strict lower bound, colour), ...), first match wins
    heat: dict[str, tuple[tuple[int, str], ...]] = field(hash=False)
    #: mode label of a hybrid ticker for which neither source had bars; None keeps the raw strategy
    failed_label: str | None = None

    def active(self, mode: str) -> tuple[Session, ...]:
        """Sessions that a harvest mode requests."""
        if mode not in MODES:
            raise ValueError(f"unknown harvest mode {mode!r}")
        return tuple(s for s in self.sessions if mode in (FULL_DAY, s.only_mode))

    def scaled(self, expected: dict[str, int] | None = None, heat: dict[str, tuple[tuple[int, str], ...]] | None = None) -> Profile:
        """The same profile for data of another density."""
        sessions = tuple(replace(s, expected=(expected or {}).get(s.name, s.expected)) for s in self.sessions)
        return replace(self, sessions=sessions, heat=self.heat | (heat or {}))


_PRE_HEAT = ((300, GREEN), (100, YELLOW))
_REG_HEAT = ((350, GREEN), (100, YELLOW))
#: No grading for POST was ever published; 90 % of the session and the shared low mark are our choice.
_POST_HEAT = ((216, GREEN), (100, YELLOW))

FULL = Profile((PRE, REG, POST), {"Total": ((900, GREEN), (700, YELLOW), (600, ORANGE)), "PRE": _PRE_HEAT, "REG": _REG_HEAT, "POST": _POST_HEAT})
LEGACY = Profile((PRE, REG), {"Total": ((700, GREEN), (330, YELLOW), (300, ORANGE)), "PRE": _PRE_HEAT, "REG": _REG_HEAT}, "HYBRID (Failed)")
