"""Record schemas. Readers take them; production paths never infer one."""

from __future__ import annotations

POSITION = "array<double>"
EPISODE = (
    "episode_id long, trajectory_id long, scene_id string, start_position array<double>, start_rotation array<double>, "
    "goals array<struct<position:array<double>,radius:double>>, "
    "instruction struct<instruction_text:string,language:string,instruction_id:string,tokens:array<string>,token_ids:array<long>>, "
    "info struct<geodesic_distance:double>, reference_path array<array<double>>, actions array<int>"
)
ANNOTATION = (
    "id string, video string, instructions array<string>, actions array<int>, "
    "render_params struct<camera_height:double,hfov:double,width:int,height:int>, source_episode string, balance_tag string, variant_idx int"
)
GT_ACTS = (
    "instruction string, instruction_id string, language string, annotator_id string, episode_id string, trajectory_id string, role string, scene_id string, "
    "traj_idx int, worker_index int, num_workers int, reference_path_len int, state_positions array<array<double>>, gt_act_sequences array<int>"
)
SAMPLE = "id string, conversations array<struct<from:string,value:string>>, image array<string>, video string, video_nframes int, data_source string"
CUSTOM_INSTRUCTION = "id long, instructions array<string>"
VERIFIED = (
    "episode_id long, scene_id string, start_position array<double>, start_rotation array<double>, goal_position array<double>, original_instruction string, "
    "height_diff double, floor_meta struct<start_level_index:int,end_level_index:int,total_levels:int,direction:string,height_diff:double,"
    "start_region_category:string,end_region_category:string,start_via:string,end_via:string>"
)
ANALYSIS = (
    "episode_id long, analysis struct<start_room:string,end_room:string,landmarks:array<string>,observable_objects:array<string>,"
    "unobservable_objects:array<string>,condition_phrase:string,decisive_unobs_object:string>"
)
REGION = "scene_id string, region_idx int, level_idx int, category string, min array<double>, max array<double>"
SESSION_COMMAND = "sid string, seq long, ts timestamp, type string, action_key string, instruction_text string, x double, y double, z double"
PREFERENCE = "prompt string, answer string, chosen string, rejected string, image string, video string"
