"""What a kernel raises on bytes that it can't read."""


class DeltaError(ValueError):
    """Bytes that are not what they should be. `kind` is a stable name for reports."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


def malformed(detail: str) -> DeltaError:
    return DeltaError("malformed", detail)


def truncated(detail: str = "") -> DeltaError:
    return DeltaError("truncated", detail)
