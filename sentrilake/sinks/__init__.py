"""Writers and report builders. Every event sink sanitizes first."""
