"""Rule-driven document-quality analytics as DataFrame plans."""
