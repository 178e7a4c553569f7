"""weftline.streaming."""
