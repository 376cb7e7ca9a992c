"""Tables of the engine as declared schemas (nothing is inferred)."""

PROMPT_FILE = "boxes array<struct<obj_id:string,frame_idx:string,xyxy:array<double>>>, points array<struct<obj_id:string,frame_idx:string,xy:array<double>,label:string>>"
PROMPTS = "video_id bigint, kind string, obj_id bigint, frame_idx bigint, xyxy array<double>, xy array<double>, label int, seq int"
VIDEOS = "video_id bigint, width int, height int, fps double, frame_count bigint"
LOGITS = "video_id bigint, frame_idx bigint, obj_id bigint, w int, h int, logits array<float>"
TIMINGS = "run_id bigint, frame_idx bigint, dt double"
BACKENDS = "name string, config string, supported boolean, precision string, engine_ok boolean, strict boolean, fallback string, mask_threshold double"
#: One mask as run lengths over row-major positions.
RUNS = "array<struct<start:int,len:int>>"
