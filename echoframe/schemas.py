"""Fixed schemas of the engine's tables."""

TRANSIENT = "attack_time_ms double, decay_time_ms double, peak_sharpness double, energy_concentration double, rise_slope double, envelope_symmetry double"
RECORDINGS = "filepath string, filename string, sample_rate int, channels int, duration double, frames long, sample_width int, error string"
CHUNKS = "source_file string, file_id string, chunk_id int, start_sample long, sample_rate int, samples array<float>"
FRAMES = "source_file string, chunk_id int, frame_idx int, ste double, tkeo double, hfc double, spectral_centroid double, spectral_flatness double, high_low_ratio double, spectral_flux double"
CANDIDATES = (
    "source_file string, file_id string, chunk_id int, peak_idx long, peak_time double, tkeo_value double, ste_value double, hfc_value double, spectral_centroid double, "
    f"high_low_ratio double, envelope_width double, confidence_score double, dolphin_likelihood double, transient_features struct<{TRANSIENT.replace(' double', ':double')}>"
)
EVENTS = (
    "peak_idx long, peak_time double, peak_amplitude double, rms double, snr_estimate double, peak_factor double, energy_ratio double, zcr double, envelope_width double, "
    "spectral_centroid double, high_low_ratio double, tkeo_value double, ste_value double, hfc_value double, confidence_score double, quality_score double, "
    "transient_attack_time_ms double, transient_decay_time_ms double, transient_peak_sharpness double, transient_energy_concentration double, transient_rise_slope double, "
    "transient_envelope_symmetry double, dolphin_likelihood double, spectral_bandwidth double, spectral_rolloff double, spectral_flatness double, file_id string, source_file string"
)
NOISE = "segment_id string, parent_id int, original_seg_id int, split string, half string, path string, start int, end int, duration_ms double"
LABELS = "start double, end double, label string"
