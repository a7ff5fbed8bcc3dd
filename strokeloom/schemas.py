"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

LANDMARK = "struct<x:double,y:double,z:double>"
FRAMES = f"session_id string, frame_idx bigint, ts timestamp, frame_w int, frame_h int, handedness string, landmarks array<{LANDMARK}>"
CONTROLS = "session_id string, ts timestamp, action string"
POINTS = "sample_id string, idx int, p double, q double, stroke_id int"
CHUNKS = "session_id string, recorder int, chunk_idx int, data binary"
TRAJECTORY = (
    "struct<points_normalized:array<array<double>>,stroke_ids:array<int>,num_strokes:int,num_points:int,"
    "features_8d:array<array<double>>,feature_names:array<string>>"
)
METADATA = (
    "app string, app_version string, sample_id string, username string, label string, created_at string, auto_saved boolean, "
    f"frame_size array<int>, media struct<image:string,video:string,video_mime:string>, trajectory {TRAJECTORY}, user_agent string"
)
MEDIA = "struct<dataUrl:string,mime:string,extension:string>"
# Keys of metadata that no schema names must survive, so it stays JSON text beside what is read from it.
REQUEST = f"username string, label string, sampleId string, createdAt string, uploadKey string, image {MEDIA}, video {MEDIA}, metadata string"
FILE = "struct<path:string,content:binary>"
