"""Thresholds of all operators; a field can be set by an environment variable of its upper-case name."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    # fixed values: limits and thresholds
    max_upload_bytes: int = 50 * 1024 * 1024
    max_pdf_pages: int = 500
    max_pdf_objects: int = 250_000
    max_pdf_nest_depth: int = 24
    max_image_pixels: int = 64_000_000
    max_image_dimension: int = 12_000
    processing_timeout_seconds: int = 90
    processing_grace_seconds: int = 15
    job_ttl_seconds: int = 900
    vector_edge_band_ratio: float = 0.12
    vector_min_span_ratio: float = 0.55
    vector_min_opacity: float = 0.85
    vector_darkness_threshold: float = 0.25
    vector_default_mode: str = "mask"
    raster_canny_low: int = 50
    raster_canny_high: int = 150
    raster_min_span_ratio: float = 0.5
    raster_max_thickness_ratio: float = 0.22
    raster_mean_intensity_max: int = 60
    raster_default_mode: str = "paint"
    audit_min_opacity: float = 0.85
    audit_darkness_threshold: float = 0.30
    audit_any_solid_color: bool = False
    audit_min_box_area_ratio: float = 0.0008
    audit_max_box_area_ratio: float = 0.85
    audit_image_color_variance_max: float = 12.0
    audit_dedupe_tolerance: float = 2.0
    forensics_max_boundary_candidates: int = 200
    forensics_max_revisions_reported: int = 50
    forensics_min_revision_bytes: int = 64
    #: on: a save is the current one only if nothing at all follows its end, and graphs deeper than max_pdf_nest_depth are refused;
    #: off: one byte may follow, and depth isn't limited
    strict: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        out = {}
        for f in fields(cls):
            if (raw := env.get(f.name.upper())) is None:
                continue
            kind = type(f.default)
            out[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**out)


DEFAULT = Settings()
