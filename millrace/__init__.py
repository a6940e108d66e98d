"""millrace: document and financial analytics as DataFrame-to-DataFrame functions."""
