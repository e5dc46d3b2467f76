"""Named queries; importing this package registers them."""

from . import datasets, drafts, evidence, exports, extraction, lifecycle, models, relational, rules, streams, workflow  # noqa: F401
