"""Sources and sinks: containers, raw frames, detections and codecs."""
