"""Engine options: one immutable record, parsed from comma-separated option strings."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Default option lists.
STATIC_EXTENSIONS = (
    ".css,.js,.jpg,.jpeg,.png,.gif,.webp,.svg,.ico,.woff,.woff2,.ttf,.eot,.otf,.map,.json,.xml,"
    ".mp4,.webm,.mp3,.wav,.zip,.pdf,.doc,.docx"
)
CRAWLER_AGENTS = (
    "googlebot,bingbot,msnbot,slurp,duckduckbot,baiduspider,yandexbot,facebookexternalhit,"
    "twitterbot,linkedinbot,whatsapp,telegrambot"
)
NOISE_PATHS = "/nodeviewcount,/analytics,/api/tracking,/api/metrics,/heartbeat,/health,/ping"
OVERRIDE_METHODS = "POST,PUT,DELETE,PATCH"
EXCLUDED_PATH_HINTS = ("nodeviewcount", "updateCounter", "analytics", "api/tracking", "api/metrics")


def split_option(text: str | None) -> tuple[str, ...]:
    """Non-blank, trimmed items of a comma-separated option, first occurrence first."""
    items = (item.strip() for item in (text or "").split(","))
    return tuple(dict.fromkeys(item for item in items if item))


@dataclass(frozen=True)
class EngineConfig:
    filter_static: bool = True
    excluded_extensions: str = STATIC_EXTENSIONS
    excluded_user_agents: str = CRAWLER_AGENTS
    excluded_status_codes: str = ""
    excluded_methods: str = ""
    included_methods_override: str = OVERRIDE_METHODS
    excluded_paths: str = NOISE_PATHS
    buffer_size: int = 50
    rag_time_window_minutes: int = 30
    retention_minutes: int = 60
    max_results: int = 100
    model: str = "rules"
    temperature: float = 0.1
    max_tokens: int | None = None
    embedding_dim: int = 64
    enabled: bool = True

    @classmethod
    def recommended(cls) -> "EngineConfig":
        """Focus on errors: drop plain successes and redirects, keep every write request."""
        return replace(
            cls(),
            excluded_status_codes="200,301,302,304",
            excluded_methods="",
            included_methods_override=OVERRIDE_METHODS,
        )

    @property
    def model_call(self):
        from vigilog.operators.prompts import ModelCall

        return ModelCall(temperature=self.temperature, max_tokens=self.max_tokens)

    @property
    def extensions(self) -> tuple[str, ...]:
        items = split_option(self.excluded_extensions) or split_option(STATIC_EXTENSIONS)
        return tuple(e.lower() if e.startswith(".") else "." + e.lower() for e in items)

    @property
    def user_agents(self) -> tuple[str, ...]:
        return tuple(a.lower() for a in split_option(self.excluded_user_agents))

    @property
    def status_codes(self) -> tuple[int, ...]:
        return tuple(int(c) for c in split_option(self.excluded_status_codes) if c.isdigit())

    @property
    def methods(self) -> tuple[str, ...]:
        return tuple(m.upper() for m in split_option(self.excluded_methods))

    @property
    def override_methods(self) -> tuple[str, ...]:
        return tuple(m.upper() for m in split_option(self.included_methods_override))

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(p.lower() for p in split_option(self.excluded_paths))
