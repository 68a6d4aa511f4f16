"""Signals as streams: sub-integrations with watermarks, level monitoring, and stateful carry-over of samples."""
