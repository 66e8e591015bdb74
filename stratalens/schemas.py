"""Declared schemas of the exchanged files, as DDL strings."""

# Evaluation items by benchmark.
ITEMS = {
    "mmlu": "item_id long, question string, choices array<string>, answer int",
    "hellaswag": "item_id long, ctx string, endings array<string>, label int",
    "truthfulqa": "item_id long, question string, mc1_targets struct<choices: array<string>, labels: array<int>>",
}

CAPTION = (
    "sample_idx long, coco_id long, url string, img_file string, generated string, refs array<string>"
)
CAPTION_LINES = f"model_id string, prompt string, {CAPTION}"
CAPTION_ENVELOPE = (
    "model_id string, prompt string, samples array<struct<sample_idx: long, coco_id: long, url: string, "
    "img_file: string, generated: string, refs: array<string>>>"
)

# The columns of an energy log, in file order.
ENERGY_LOG = """
timestamp timestamp_ntz, project_name string, run_id string, experiment_id string, duration double,
emissions double, emissions_rate double, cpu_power double, gpu_power double, ram_power double,
cpu_energy double, gpu_energy double, ram_energy double, energy_consumed double, water_consumed double,
country_name string, country_iso_code string, region string, cloud_provider string, cloud_region string,
os string, python_version string, codecarbon_version string, cpu_count int, cpu_model string,
gpu_count int, gpu_model string, longitude double, latitude double, ram_total_size double,
tracking_mode string, cpu_utilization_percent double, gpu_utilization_percent double,
ram_utilization_percent double, ram_used_gb double, on_cloud string, pue double, wue double
"""

RUN_RESULT = """
run_id string, model_id string, dtype string, n_params_B double, dataset string, n_samples long, prompt string,
quality struct<bleu4: double, rougeL: double, meteor: double, description: string>,
speed struct<total_time_s: double, throughput_samples_per_s: double, mean_latency_ms: double, std_latency_ms: double>,
energy struct<energy_kwh: double, co2_kg: double, note: string>,
hardware struct<peak_vram_mib: double, total_vram_mib: double, device: string, gpu_name: string>
"""

HISTORY = "run_id string, seq long, accuracy double"

PLAN = """
model string, n int, block_start int, block_end int,
plan struct<slices: array<struct<sources: array<struct<model: string, layer_range: array<int>>>>>,
merge_method: string, dtype: string>
"""
