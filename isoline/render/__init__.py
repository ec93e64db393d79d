"""The layer pipeline: fitting, anchors, placement, drawing commands, SVG."""
